"""Queries of term counting, scoring, classification and keyword selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import keywords, reclassify, scoring
from quillmill.operators.registry import SAMPLE
from quillmill.plans.base import query, read

# ---- the same terms and rules in SQL


def _quote(s: str) -> str:
    return s.replace("'", "''")


def _values(rows) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{_quote(v)}'"
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


TERMS = f"terms(domain, ord, kind, term_ord, term) AS (VALUES {_values(SAMPLE.terms())})"
FOLDED = "replace(lower({0}), 'ß', 'ss')"


def _matrix(name: str, source: str, text: str, rule: str) -> str:
    """Counts of each term. DuckDB's patterns have no look-around: every character that bounds a term is doubled instead."""
    word = "'^[a-z0-9]+$'" if rule == "narrow" else "'^[a-z0-9][a-z0-9 ._-]*$'"
    return f"""{name}_t AS (SELECT id, {FOLDED.format(text)} AS t, '#' || regexp_replace({FOLDED.format(text)}, '([^a-z0-9])', '\\1\\1', 'g') || '#' AS b FROM {source}),
{name} AS (SELECT id, k AS term, n FROM (SELECT id, k, CASE WHEN regexp_matches(k, {word})
    THEN len(regexp_extract_all(b, '[^a-z0-9]' || replace(regexp_replace(k, '([^a-z0-9])', '\\1\\1', 'g'), '.', '\\.') || '[^a-z0-9]'))
    ELSE (length(t) - length(replace(t, k, ''))) // length(k) - CASE WHEN '{rule}' = 'wide' AND k = '基金' THEN (length(t) - length(replace(t, '基金会', ''))) // 3 ELSE 0 END END AS n
  FROM {name}_t, (SELECT DISTINCT lower(term) AS k FROM terms) WHERE contains(t, k)) WHERE n > 0)"""


DOCS = "docs AS (SELECT doc_id AS id, text, title, domain FROM documents)"
NARROW = f"{TERMS}, {DOCS}, {_matrix('m', 'docs', 'text', 'narrow')}"
GATE = f"""{NARROW}, scores AS (SELECT id, domain, ord,
    CAST(sum(CASE WHEN kind = 'core' THEN 3 * least(n, 3) ELSE least(n, 2) END) AS INTEGER) AS score,
    count_if(kind = 'core') >= 2 OR sum(CASE WHEN kind = 'core' THEN n ELSE 0 END) >= 2 OR (count_if(kind = 'core') >= 1 AND count_if(kind = 'support') >= 2)
      OR (domain = 'AI' AND count_if(kind = 'support') >= 4) AS eligible,
    string_agg(t.term, ',' ORDER BY kind, term_ord) AS evidence
  FROM m JOIN terms t ON m.term = lower(t.term) GROUP BY id, domain, ord)"""
PRIMARY = f"""{GATE}, top AS (SELECT id, domain, score, count(*) OVER (PARTITION BY id, score) AS same, rank() OVER (PARTITION BY id ORDER BY score DESC) AS r FROM scores WHERE eligible),
prim AS (SELECT DISTINCT id, CASE WHEN same = 1 THEN domain ELSE '' END AS domain, score, same = 1 AND domain <> 'Quant' AS matched,
  CASE WHEN same > 1 THEN 'tie' WHEN domain = 'Quant' THEN 'not allowed' ELSE 'primary' END AS reason FROM top WHERE r = 1)"""

ALL_TERMS = [t for _, _, _, _, t in SAMPLE.terms()]
ALLOWED = [n for n in SAMPLE.names if n != "Quant"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def narrow(spark: SparkSession, d: str) -> DataFrame:
    return scoring.term_matrix(docs(spark, d), "doc_id", F.col("text"), ALL_TERMS, "narrow")


def gate(spark: SparkSession, d: str) -> DataFrame:
    return scoring.gate_scores(narrow(spark, d), SAMPLE)


@query(f"WITH {NARROW} SELECT id AS doc_id, term, CAST(n AS INTEGER) AS n FROM m")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each term by the narrow rule, in Arrow batches."""
    return narrow(spark, d).withColumnRenamed("id", "doc_id")


@query(f"WITH {NARROW} SELECT id AS doc_id, term, CAST(n AS INTEGER) AS n FROM m")
def term_counts_native(spark: SparkSession, d: str) -> DataFrame:
    """The same counts without Python."""
    return scoring.term_matrix_native(docs(spark, d), "doc_id", F.col("text"), SAMPLE).withColumnRenamed("id", "doc_id")


@query(f"WITH {TERMS}, {DOCS}, {_matrix('m', 'docs', 'text', 'wide')} SELECT id AS doc_id, term, CAST(n AS INTEGER) AS n FROM m")
def term_counts_wide(spark: SparkSession, d: str) -> DataFrame:
    """Counts by the wide rule: terms of several ASCII words need bounds too."""
    return scoring.term_matrix(docs(spark, d), "doc_id", F.col("text"), ALL_TERMS, "wide").withColumnRenamed("id", "doc_id")


@query(f"WITH {GATE} SELECT id AS doc_id, domain, score, eligible, evidence FROM scores")
def gate_scores(spark: SparkSession, d: str) -> DataFrame:
    return gate(spark, d).select(F.col("id").alias("doc_id"), "domain", "score", "eligible", "evidence")


@query(f"WITH {PRIMARY} SELECT id AS doc_id, domain, score, matched, reason FROM prim")
def primary_domain(spark: SparkSession, d: str) -> DataFrame:
    """The one domain with the highest score; Quant is not allowed in this job."""
    return scoring.primary_domain(gate(spark, d), ALLOWED).withColumnRenamed("id", "doc_id")


@query(f"WITH {PRIMARY} SELECT domain, reason, count(*) AS docs FROM prim GROUP BY 1, 2")
def primary_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.primary_domain(gate(spark, d), ALLOWED).groupBy("domain", "reason").agg(F.count("*").alias("docs"))


@query(f"""WITH {GATE}, j AS (SELECT docs.id, docs.domain AS target, s.domain, s.score, s.eligible FROM docs LEFT JOIN scores s ON docs.id = s.id WHERE docs.domain IS NOT NULL),
r AS (SELECT id, target, coalesce(max(score) FILTER (domain = target), 0) AS score, coalesce(bool_or(eligible) FILTER (domain = target), false) AS fit,
  min({{'s': -score, 'd': domain}}) FILTER (eligible AND domain <> target) AS rival FROM j GROUP BY 1, 2)
SELECT id AS doc_id, target, score, fit AND NOT coalesce(-rival.s >= score, false) AS matched,
  CASE WHEN NOT fit OR coalesce(-rival.s >= score, false) THEN rival.d END AS competitor,
  CASE WHEN NOT fit THEN 'too little' WHEN -rival.s = score THEN 'tie' WHEN -rival.s > score THEN 'closer to another' ELSE 'match' END AS reason FROM r""")
def domain_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the domain that it is stored under."""
    targets = docs(spark, d).where("domain is not null").select(F.col("doc_id").alias("id"), F.col("domain").alias("target"))
    return scoring.domain_gate(targets, gate(spark, d)).withColumnRenamed("id", "doc_id")


FIELDS = f"""{TERMS}, {DOCS}, {_matrix('mt', 'docs', 'title', 'wide')}, {_matrix('mb', 'docs', 'text', 'wide')},
h AS (SELECT x.id, t.domain, t.ord, t.kind, lower(t.term) AS k, n, w, w * CASE WHEN kind = 'core' THEN 4 * least(n, 3) ELSE least(n, 2) END AS p
  FROM (SELECT *, 5 AS w FROM mt UNION ALL SELECT *, 1 FROM mb) x JOIN terms t ON x.term = lower(t.term)),
f AS (SELECT id, domain, ord, CAST(sum(p) AS INTEGER) AS score, CAST(coalesce(sum(p) FILTER (w > 1), 0) AS INTEGER) AS title_score, CAST(coalesce(sum(p) FILTER (w = 1), 0) AS INTEGER) AS body_score,
  CAST(count_if(kind = 'core' AND w > 1) AS INTEGER) AS title_cores, CAST(count_if(kind = 'core' AND w = 1) AS INTEGER) AS body_cores, CAST(count(DISTINCT k) FILTER (kind = 'core') AS INTEGER) AS cores
  FROM h GROUP BY 1, 2, 3)"""

RULES = reclassify.TitleRules(
    forced=(("Quant", "(?i)回测|backtest"), ("中医", "中医|针灸"), ("知识管理", "卡片笔记|第二大脑|second brain")),
    fallback=(("AI", "(?i)模型|智能体|language model"), ("个人成长", "自律|复盘|mentor"), ("投资理财", "基金|房贷|(?i)mortgage")),
    specific=frozenset({"Quant", "中医", "知识管理", "投资理财"}),
    guarded=(("AI", "个人成长"),),
)


def fields(spark: SparkSession, d: str) -> DataFrame:
    matrix = lambda c: scoring.term_matrix(docs(spark, d), "doc_id", F.col(c), ALL_TERMS, "wide")
    return scoring.field_scores(matrix("title"), matrix("text"), SAMPLE)


@query(f"WITH {FIELDS} SELECT id AS doc_id, domain, score, title_score, body_score, title_cores, body_cores, cores FROM f")
def field_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores with the title at five times the weight."""
    return fields(spark, d).select(F.col("id").alias("doc_id"), "domain", "score", "title_score", "body_score", "title_cores", "body_cores", "cores")


def _rules_sql(rules: tuple) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for n, p in rules) + " END"


@query(f"""SELECT doc_id, {_rules_sql(RULES.forced)} AS forced, {_rules_sql(RULES.fallback)} AS hint,
  concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(title, '{p}') THEN '{n}' END" for n, p in RULES.fallback)}) AS hints FROM documents""")
def title_rules(spark: SparkSession, d: str) -> DataFrame:
    """What a title's words force and hint at."""
    t = F.col("title")
    return docs(spark, d).select("doc_id", reclassify.first_rule(t, RULES.forced).alias("forced"), reclassify.first_rule(t, RULES.fallback).alias("hint"), F.concat_ws(",", reclassify.all_rules(t, RULES.fallback)).alias("hints"))


def _decisions_sql() -> str:
    """The rules of reclassify() over one row for each document, with the scores in lists."""
    spec = ", ".join(f"'{x}'" for x in sorted(RULES.specific))
    of = lambda dom, what: f"coalesce(list_filter(s, lambda x: x.domain = {dom})[1].{what}, 0)"
    return f"""WITH {FIELDS}, g AS (SELECT id, list({{'domain': domain, 'score': score, 'title_score': title_score, 'body_score': body_score, 'title_cores': title_cores, 'body_cores': body_cores, 'cores': cores}}) AS s FROM f GROUP BY id),
a AS (SELECT docs.id, docs.domain AS cur, coalesce(s, []) AS s, {_rules_sql(RULES.forced)} AS forced, {_rules_sql(RULES.fallback)} AS hint,
  list_filter([{', '.join(f"CASE WHEN regexp_matches(title, '{p}') THEN '{n}' END" for n, p in RULES.fallback)}], lambda x: x IS NOT NULL) AS hints
  FROM docs LEFT JOIN g ON docs.id = g.id WHERE docs.domain IS NOT NULL),
b AS (SELECT *, coalesce(list_max(list_transform(s, lambda x: x.title_score)), 0) AS top,
  coalesce(forced, CASE WHEN coalesce(list_max(list_transform(s, lambda x: x.title_score)), 0) >= 8
    THEN list_max(list_transform(s, lambda x: {{'a': x.title_score, 'b': x.score, 'c': x.domain}})).c ELSE list_max(list_transform(s, lambda x: {{'b': x.score, 'c': x.domain}})).c END) AS tgt FROM a),
c AS (SELECT *, {of('cur', 'score')} AS c_score, {of('cur', 'title_score')} AS c_title, {of('cur', 'body_score')} AS c_body, {of('cur', 'body_cores')} AS c_cores,
  {of('tgt', 'score')} AS t_score, {of('tgt', 'title_cores')} AS t_title_cores, {of('tgt', 'cores')} AS t_cores, {of("'个人成长'", 'body_score')} AS growth,
  forced IS NULL OR forced = cur AS free, list_contains(hints, cur) AS hinted, len(list_filter(hints, lambda x: x IN ({spec}) AND x <> cur)) > 0 AS rival, cur IN ({spec}) AS spec FROM b),
e AS (SELECT *, (cur = 'AI' AND free AND list_contains(hints, '个人成长') AND c_cores >= 3 AND c_body >= 16 AND c_body >= growth + 8)
  OR (free AND hinted AND (len(hints) = 1 OR spec OR (NOT rival AND c_title >= top - 5))) OR (free AND spec AND c_title >= 8)
  OR (free AND c_title >= 8 AND c_title = top AND (spec OR NOT rival)) AS stays,
  CASE WHEN hint = cur THEN 'keep' WHEN hint IS NOT NULL THEN 'hint' ELSE 'unclassified' END AS by_hint,
  t_title_cores > 0 OR coalesce(list_contains(hints, tgt), false) AS backs FROM c),
w AS (SELECT *, CASE WHEN stays THEN 'keep' WHEN tgt IS NULL OR t_score < 8 OR t_cores = 0 THEN by_hint WHEN tgt = cur THEN 'keep' WHEN forced IS NOT NULL THEN 'move'
  WHEN NOT backs AND c_score >= 8 AND t_score < c_score + 8 THEN 'keep' WHEN NOT backs AND t_cores < 3 THEN CASE WHEN c_score >= 8 THEN 'keep' ELSE by_hint END
  WHEN t_score < c_score + 4 THEN 'ambiguous' ELSE 'move' END AS what FROM e)
SELECT id AS doc_id, CASE WHEN what = 'hint' THEN 'move' ELSE what END AS decision, CASE what WHEN 'keep' THEN cur WHEN 'hint' THEN hint WHEN 'move' THEN tgt END AS target FROM w"""


DECISIONS = _decisions_sql()


def decided(spark: SparkSession, d: str) -> DataFrame:
    have = docs(spark, d).where("domain is not null").select(F.col("doc_id").alias("id"), "title", F.col("domain").alias("current"))
    return reclassify.reclassify(have, fields(spark, d), SAMPLE, RULES).withColumnRenamed("id", "doc_id")


@query(DECISIONS)
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    """Keep, move, ambiguous or unclassified, for each document with a domain."""
    return decided(spark, d)


@query(f"SELECT decision, count(*) AS docs FROM ({DECISIONS}) GROUP BY 1")
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).groupBy("decision").agg(F.count("*").alias("docs"))


# ---- keyword union

JOB = {"AI": ["大模型", "language model", "GPT"], "健康医学": ["血压", "blood pressure", "睡眠"], "投资理财": ["房贷", "mortgage"], "剪报": ["周报", "weekly"]}
ALIASES = {"大模型": ["智能体", "LLM"], "血压": ["心率"], "weekly": ["memo", "Memo"]}
_HITS = [(domain, di, word, ki, t) for domain, di, word, ki, t, _ in keywords.expand(JOB, ALIASES)]


@query(f"SELECT * FROM (VALUES {_values(keywords.expand(JOB, ALIASES))}) AS x(domain, dom_ord, keyword, kw_ord, term, term_ord)")
def alias_expand(spark: SparkSession, d: str) -> DataFrame:
    """Each keyword with its aliases; equal ones once."""
    return keywords.expanded_frame(spark, JOB, ALIASES)


@query(f"""WITH x(domain, di, keyword, ki, term) AS (VALUES {_values(_HITS)}),
docs AS (SELECT doc_id, lower(title) || chr(10) || lower(text) AS t, '#' || regexp_replace(lower(title) || chr(10) || lower(text), '([^a-z0-9])', '\\1\\1', 'g') || '#' AS b FROM documents),
hit AS (SELECT doc_id, domain, di, keyword, ki, term FROM docs, x WHERE CASE WHEN regexp_matches(lower(term), '^[a-z0-9]+([ ._-][a-z0-9]+)*$')
  THEN regexp_matches(b, '[^a-z0-9]' || regexp_replace(lower(term), '([^a-z0-9])', '\\1\\1', 'g') || '[^a-z0-9]') ELSE contains(t, lower(term)) END),
per AS (SELECT doc_id, domain, di, count(DISTINCT keyword) AS n FROM hit GROUP BY ALL),
best AS (SELECT doc_id, arg_max(domain, {{'n': n, 'd': -di}}) AS keyword_domain FROM per GROUP BY 1),
words AS (SELECT doc_id, string_agg(keyword, ',' ORDER BY di, ki) AS keywords FROM (SELECT DISTINCT doc_id, di, ki, keyword FROM hit) GROUP BY 1)
SELECT docs.doc_id, keyword_domain IS NOT NULL AS matched, keyword_domain, coalesce(keywords, '') AS keywords FROM docs LEFT JOIN best USING (doc_id) LEFT JOIN words USING (doc_id)""")
def keyword_union(spark: SparkSession, d: str) -> DataFrame:
    """The domain with the most matched keywords, and these; folded by lower case, as the SQL has no NFKC."""
    u = keywords.keyword_union(docs(spark, d), "doc_id", F.lower("title"), F.lower("text"), JOB, ALIASES)
    return u.select(F.col("id").alias("doc_id"), "matched", "keyword_domain", F.concat_ws(",", "keywords").alias("keywords"))


@query()
def keyword_union_full(spark: SparkSession, d: str) -> DataFrame:
    """With NFKC folding, and the reclassifier's say where the domain is one of the registry."""
    u = keywords.keyword_union(docs(spark, d), "doc_id", T.full_fold(F.col("title")), T.full_fold(F.col("text")), JOB, ALIASES)
    have = docs(spark, d).select(F.col("doc_id").alias("id"), "title").join(u.where(F.col("keyword_domain").isin(SAMPLE.names)).select("id", F.col("keyword_domain").alias("current")), "id")
    said = reclassify.reclassify(have, fields(spark, d), SAMPLE, RULES).select("id", F.when(F.col("decision").isin("keep", "move"), F.col("target")).alias("said"))
    return u.join(said, "id", "left").select(F.col("id").alias("doc_id"), "matched", F.coalesce("said", "keyword_domain").alias("primary_domain"), F.concat_ws(",", "keywords").alias("keywords"), F.concat_ws(",", "terms").alias("terms"))
