"""Term matrix, domain scores and the export gate.

Terms are rows, not columns, so a registry of any size compiles; documents meet them either in the native form
(a small table of terms on every executor, with a cheap test before each pattern) or, for large registries, in Arrow batches with compiled patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import DIGIT_MAY_FOLLOW, LESS_LONGER_WORD, _RUN, _WORDS, bounded, fold
from quillmill.operators.registry import Registry
from quillmill.session import filled_frames


def _counter(term: str, rule: str):
    """Function from folded text to the count of one term."""
    if (_RUN if rule == "narrow" else _WORDS).fullmatch(term):
        pattern = re.compile(bounded(term, rule == "wide" and term in DIGIT_MAY_FOLLOW))
        return lambda t: len(pattern.findall(t))
    longer = LESS_LONGER_WORD.get(term) if rule == "wide" else None
    if longer:
        return lambda t: max(0, t.count(term) - t.count(longer))
    return lambda t: t.count(term)


def term_matrix(docs: DataFrame, id_col: str, text: Column, terms: list[str], rule: str = "narrow") -> DataFrame:
    """(id, term, n) for n > 0: counts of each term in the case-folded text, by the narrow or wide rule.

    One pass over the text in Arrow batches: a plain test for each term, and its compiled pattern only where that hits. Null
    texts have no terms; a repeated term counts once; null ids are kept.
    """
    terms = list(dict.fromkeys(t.casefold() for t in terms if t))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = [(t, _counter(t, rule)) for t in terms]
        for pdf in batches:
            ids, names, ns = [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                if not text:
                    continue
                text = text.casefold()
                for t, f in counters:
                    if t in text and (n := f(text)):
                        ids.append(i)
                        names.append(t)
                        ns.append(n)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=pdf["id"].dtype), "term": names, "n": pd.Series(ns, dtype="int32")})

    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInPandas(filled_frames(count), f"id {kind}, term string, n int")


def term_matrix_native(docs: DataFrame, id_col: str, text: Column, registry: Registry) -> DataFrame:
    """term_matrix() by the narrow rule without Python: for small registries. Each term is an expression with a fixed pattern over the
    row's own text, so no row is multiplied before a term has hit."""
    found = []
    for term in dict.fromkeys(t.lower() for *_, t in registry.terms()):
        if re.fullmatch("[a-z0-9]+", term):
            n = F.regexp_count("text", F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))
        else:
            n = ((F.length("text") - F.length(F.replace("text", F.lit(term), F.lit("")))) / len(term)).cast("int")
        found.append(F.when(F.col("text").contains(term), F.struct(F.lit(term).alias("term"), n.cast("int").alias("n"))))
    texts = docs.select(F.col(id_col).alias("id"), fold(text).alias("text"))
    return texts.select("id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull() & (x["n"] > 0))).alias("x")).select("id", "x.term", "x.n")


def gate_scores(matrix: DataFrame, registry: Registry) -> DataFrame:
    """(id, domain, ord, score, eligible, evidence): each domain with a hit, by the export gate.

    Core terms give 3 for each of at most 3 hits, support terms 1 for each of at most 2; a term in both lists counts in both. Eligible: two
    core terms, or two core hits, or a core and two support terms, or support_only_min support terms.
    """
    terms = registry.frame(matrix.sparkSession).withColumn("key", F.lower("term"))
    hits = matrix.join(F.broadcast(terms), matrix["term"] == terms["key"]).select("id", "domain", "ord", "kind", "term_ord", terms["term"].alias("name"), "n")
    core, support = F.col("kind") == "core", F.col("kind") == "support"
    alone = F.create_map(*[F.lit(x) for d in registry.domains if d.support_only_min for x in (d.name, d.support_only_min)]) if any(d.support_only_min for d in registry.domains) else None
    scored = hits.groupBy("id", "domain", "ord").agg(
        F.sum(F.when(core, 3 * F.least("n", F.lit(3))).otherwise(F.least("n", F.lit(2)))).cast("int").alias("score"),
        F.count_if(core).alias("cores"),
        F.sum(F.when(core, F.col("n")).otherwise(0)).alias("core_hits"),
        F.count_if(support).alias("supports"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "term_ord", "name"))), lambda x: x["name"]), ",").alias("evidence"),
    )
    eligible = (F.col("cores") >= 2) | (F.col("core_hits") >= 2) | ((F.col("cores") >= 1) & (F.col("supports") >= 2))
    if alone is not None:
        eligible = eligible | F.coalesce(F.col("supports") >= alone[F.col("domain")], F.lit(False))
    return scored.select("id", "domain", "ord", "score", eligible.alias("eligible"), "evidence")


def primary_domain(scores: DataFrame, allowed: list[str]) -> DataFrame:
    """(id, domain, score, matched, reason) of each id with an eligible domain: the one with the highest score.

    A tie gives no domain; a domain that is not allowed is named but not matched.
    """
    best = (
        scores.where("eligible")
        .groupBy("id")
        .agg(F.max_by("domain", F.struct("score")).alias("_"), F.max("score").alias("score"), F.collect_list(F.struct("score", "domain")).alias("all"))
    )
    top = F.filter("all", lambda x: x["score"] == F.col("score"))
    one = F.size(top) == 1
    name = F.when(one, top[0]["domain"]).otherwise("")
    return best.select("id", name.alias("domain"), "score", one.alias("one")).select(
        "id",
        "domain",
        "score",
        (F.col("one") & F.col("domain").isin(allowed)).alias("matched"),
        F.when(~F.col("one"), "tie").when(~F.col("domain").isin(allowed), "not allowed").otherwise("primary").alias("reason"),
    )


def domain_gate(targets: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, target, score, matched, competitor, reason) for targets (id, target).

    Rejected if the target is not eligible, or if an eligible other domain reaches its score; the competitor is the
    one with the highest score, then the smallest name.
    """
    joined = targets.join(scores, "id", "left")
    mine, other = F.col("domain") == F.col("target"), F.col("eligible") & (F.col("domain") != F.col("target"))
    rows = joined.groupBy("id", "target").agg(
        F.coalesce(F.max(F.when(mine, F.col("score"))), F.lit(0)).alias("score"),
        F.coalesce(F.max(F.when(mine, F.col("eligible"))), F.lit(False)).alias("fit"),
        F.min(F.when(other, F.struct((-F.col("score")).alias("s"), "domain"))).alias("rival"),
    )
    beaten = F.coalesce(-F.col("rival.s") >= F.col("score"), F.lit(False))
    return rows.select(
        "id",
        "target",
        "score",
        (F.col("fit") & ~beaten).alias("matched"),
        F.when(~F.col("fit") | beaten, F.col("rival.domain")).alias("competitor"),
        F.when(~F.col("fit"), "too little").when(beaten & (-F.col("rival.s") == F.col("score")), "tie").when(beaten, "closer to another").otherwise("match").alias("reason"),
    )


def field_scores(title: DataFrame, body: DataFrame, registry: Registry, title_weight: int = 5) -> DataFrame:
    """(id, domain, ord, score, title_score, body_score, title_cores, body_cores, cores) from two matrices by the wide rule.

    Core terms give 4 for each of at most 3 hits, support terms 1 for each of at most 2, times title_weight in the title.
    """
    terms = registry.frame(title.sparkSession).withColumn("key", F.lower("term"))
    both = title.withColumn("w", F.lit(title_weight)).unionByName(body.withColumn("w", F.lit(1)))
    hits = both.join(F.broadcast(terms), both["term"] == terms["key"])
    core, in_title = F.col("kind") == "core", F.col("w") > 1
    points = F.col("w") * F.when(core, 4 * F.least("n", F.lit(3))).otherwise(F.least("n", F.lit(2)))
    return hits.groupBy("id", "domain", "ord").agg(
        F.sum(points).cast("int").alias("score"),
        F.coalesce(F.sum(F.when(in_title, points)), F.lit(0)).cast("int").alias("title_score"),
        F.coalesce(F.sum(F.when(~in_title, points)), F.lit(0)).cast("int").alias("body_score"),
        F.count_if(core & in_title).cast("int").alias("title_cores"),
        F.count_if(core & ~in_title).cast("int").alias("body_cores"),
        F.count_distinct(F.when(core, F.col("key"))).cast("int").alias("cores"),
    )


def analyses(bodies: DataFrame, scores: DataFrame) -> DataFrame:
    """bodies (id, body, ...) with scores and evidence, arrays of (domain, value) in the registry's order, and labels, the eligible domains.

    scores: gate_scores(). A body without any term has empty arrays. At most one entry for each domain of the registry.
    """
    entries = F.array_sort(F.collect_list(F.struct("ord", "domain", "score", "evidence", "eligible")))
    g = scores.groupBy("id").agg(entries.alias("_e"))
    e = F.coalesce("_e", F.array().cast("array<struct<ord:int,domain:string,score:int,evidence:string,eligible:boolean>>"))
    pick = lambda name: F.transform("_e", lambda x: F.struct(x["domain"].alias("domain"), x[name].alias("value")))
    j = bodies.join(g, "id", "left").withColumn("_e", e)
    return j.withColumns({"scores": pick("score"), "evidence": pick("evidence"), "labels": F.transform(F.filter("_e", lambda x: x["eligible"]), lambda x: x["domain"])}).drop("_e")
