"""Queries of text extraction, normalisation and stored-document parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import markdown as M
from quillmill.functions import text as T
from quillmill.operators import dedup
from quillmill.plans.base import query, read


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


#: DuckDB's form of functions.text.visible_text().
VISIBLE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'),
  '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '</?[A-Za-z][^>]*>', ' ', 'gs'),
  '&nbsp;', chr(160)), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
  '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"""


@query(f"SELECT doc_id, length(v) AS chars, sha256(v) AS body_sha256 FROM (SELECT doc_id, {VISIBLE} AS v FROM documents)")
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text and its hash."""
    v = docs(spark, d).select("doc_id", T.visible_text(F.col("text")).alias("v"))
    return v.select("doc_id", F.length("v").cast("long").alias("chars"), F.sha2("v", 256).alias("body_sha256"))


@query(f"""SELECT doc_id, CASE WHEN length(v) > 360 THEN regexp_replace(substr(v, 1, 360), '[，,；;。 ]+$', '') || '……' ELSE v END AS summary
FROM (SELECT doc_id, {VISIBLE} AS v FROM documents)""")
def cache_summary(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.visible_text(F.col("text")).alias("v")).select("doc_id", T.cache_summary(F.col("v")).alias("summary"))


_COUNT = "(length(text) - length(replace(text, '{0}', ''))) // length('{0}')"


_LOW = "(length(low) - length(replace(low, '{0}', ''))) // length('{0}')"


@query(f"""SELECT doc_id, contains(low, '<!doctype') AS has_doctype, contains(low, '<html') AS has_html_tags, contains(low, '<head') AS has_head, contains(low, '<body') AS has_body,
  contains(low, '<en-note') AS has_en_note, contains(text, '--en-clipped-content') AS en_clipped, {_LOW.format('<div')} AS div_count, {_LOW.format('<span')} AS span_count, {_LOW.format('<p')} AS p_count,
  CASE WHEN contains(low, '<html') AND contains(low, '<head') AND contains(low, '<body') THEN 'html' WHEN contains(low, '<en-note') THEN 'enml' ELSE 'fragment' END AS kind
FROM (SELECT doc_id, text, lower(text) AS low FROM documents)""")
def markup_summary(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", *T.markup_summary(F.col("text")))


_CLIP = f"(contains(text, '--en-clipped-content') OR {_COUNT.format('<div')} + {_COUNT.format('<span')} + {_COUNT.format('<script')} + {_COUNT.format('<style')} >= 3)"


@query(f"""SELECT doc_id, {_CLIP} AS is_clip, CASE WHEN contains(text, '--en-clipped-content') AND strlen(text) >= 204800 THEN 'page_beside' WHEN {_CLIP} THEN 'clip'
  WHEN contains(text, '](_attachments/') THEN 'with_files' ELSE 'plain' END AS note_type FROM documents""")
def note_types(spark: SparkSession, d: str) -> DataFrame:
    """How each document would be stored."""
    text = F.col("text")
    return docs(spark, d).select("doc_id", T.is_clip(text).alias("is_clip"), T.note_type(text, F.octet_length(text), text.contains("](_attachments/")).alias("note_type"))


#: DuckDB's form of functions.text.plain_markdown().
PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
  '[*_`~]', '', 'g'), '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"""
BODY = r"regexp_replace(text, '\A---\r?\n(?s:.*?)\r?\n---[ \t]*(\r?\n|\z)', '')"


@query(f"SELECT doc_id, sha256({PLAIN.format('text')}) AS plain_sha, length({PLAIN.format('text')}) AS chars FROM documents")
def plain_markdown(spark: SparkSession, d: str) -> DataFrame:
    p = docs(spark, d).select("doc_id", T.plain_markdown(F.col("text")).alias("p"))
    return p.select("doc_id", F.sha2("p", 256).alias("plain_sha"), F.length("p").cast("long").alias("chars"))


@query(rf"SELECT doc_id, nullif(regexp_extract({BODY}, '(?m)^# +(.+?)[ \t\r]*$', 1), '') AS heading, lower({PLAIN.format('title')}) AS normal_title FROM documents")
def headings(spark: SparkSession, d: str) -> DataFrame:
    """First heading of the body, and the title without marks in lower case."""
    return docs(spark, d).select("doc_id", T.first_heading(T.body_of(F.col("text"))).alias("heading"), F.lower(T.plain_markdown(F.col("title"))).alias("normal_title"))


_FIELD = r"""nullif(trim(regexp_extract(regexp_extract(text, '\A---\r?\n((?s:.*?))\r?\n---[ \t]*(\r?\n|\z)', 1), '(?m)^{0}:([^\r\n]*)', 1)), '')"""


@query("SELECT doc_id, " + ", ".join(f"{_FIELD.format(k)} AS {a}" for k, a in (("source_guid", "guid"), ("domain", "domain"), ("type", "type"), ("created", "created"), ("updated", "updated"))) + " FROM documents")
def frontmatter_parse(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the header block; null where it lacks them."""
    f = docs(spark, d).select("doc_id", T.header_fields(F.col("text")).alias("f"))
    get = lambda k: F.when(F.col("f")[k] != "", F.col("f")[k])
    return f.select("doc_id", get("source_guid").alias("guid"), get("domain").alias("domain"), get("type").alias("type"), get("created").alias("created"), get("updated").alias("updated"))


def _quoted(c: str) -> str:
    return rf"""'"' || replace(replace({c}, '\', '\\'), '"', '\"') || '"'"""


@query(rf"""SELECT doc_id, concat_ws(chr(10), '---', 'title: ' || {_quoted('title')}, 'source_guid: ' || {_quoted('source_guid')}, 'type: ' || {_quoted('type')}, 'domain: ' || {_quoted('domain')}, '---') AS header FROM documents""")
def frontmatter_render(spark: SparkSession, d: str) -> DataFrame:
    order = ["title", "source_guid", "type", "domain"]
    return docs(spark, d).select("doc_id", T.header_block({k: F.col(k) for k in order}, order).alias("header"))


@query(rf"""SELECT doc_id, CASE WHEN len(regexp_extract_all(regexp_extract(text, '\A---\r?\n((?s:.*?))\r?\n---', 1), '(?m)^domain:')) = 1
  THEN sha256(regexp_replace(text, '(?m)^domain:[^\r\n]*', 'domain: "新领域"')) END AS new_sha FROM documents WHERE starts_with(text, '---')""")
def domain_update(spark: SparkSession, d: str) -> DataFrame:
    """The header's one domain line replaced; null where there isn't exactly one."""
    text = F.col("text")
    block = F.regexp_extract(text, r"\A---\r?\n((?s:.*?))\r?\n---", 1)
    first = F.regexp_extract(text, r"(?m)^domain:[^\r\n]*", 0)
    out = F.concat(text.substr(F.lit(1), F.expr("regexp_instr(text, '(?m)^domain:') - 1")), F.lit('domain: "新领域"'), text.substr(F.expr("regexp_instr(text, '(?m)^domain:')") + F.length(first), F.length(text)))
    one = F.regexp_count(block, F.lit("(?m)^domain:")) == 1
    return docs(spark, d).where(text.startswith("---")).select("doc_id", F.when(one, F.sha2(out, 256)).alias("new_sha"))


_RESERVED = ", ".join(f"'{n}'" for n in T.RESERVED_NAMES)


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(title, '[\x00-\x1f\x7f<>:"/\\|?*]', '_', 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(STRIP(t), '[. ]+$', '') AS t FROM a),
c AS (SELECT doc_id, CASE WHEN upper(split_part(t, '.', 1)) IN ({_RESERVED}) THEN '_' || t ELSE t END AS t FROM b), e AS (SELECT *, regexp_extract(t, '(\.[A-Za-z0-9]{{1,10}})$', 1) AS ext FROM c)
SELECT doc_id, CASE WHEN t = '' THEN 'untitled' WHEN length(t) > 120 THEN substr(t, 1, 120 - length(ext)) || ext ELSE t END AS name FROM e""")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.safe_filename(F.col("title")).alias("name"))


@query(r"""
WITH x AS (SELECT doc_id, coalesce(domain, '未分类') AS folder, coalesce(source_guid, CAST(doc_id AS VARCHAR)) AS guid, regexp_replace(STRIP(title), '[\x00-\x1f<>:"/\\|?*]', '_', 'g') AS name FROM documents),
y AS (SELECT *, dense_rank() OVER (PARTITION BY folder, name ORDER BY guid) AS pl FROM x),
z AS (SELECT *, dense_rank() OVER (PARTITION BY folder, name, substr(guid, 1, 8), pl > 1 ORDER BY guid) AS again FROM y)
SELECT doc_id, folder || '/' || CASE WHEN pl = 1 THEN name WHEN again = 1 THEN name || '_' || substr(guid, 1, 8) ELSE name || '_' || substr(sha256(guid), 1, 12) END || '.md' AS path FROM z""")
def unique_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths without collisions."""
    x = docs(spark, d).select("doc_id", F.coalesce("domain", F.lit("未分类")).alias("folder"), F.coalesce("source_guid", F.col("doc_id").cast("string")).alias("guid"), "title")
    return dedup.unique_paths(x, "folder", F.regexp_replace(T.strip(F.col("title")), r'[\x00-\x1f<>:"/\\|?*]', "_"), "guid").select("doc_id", "path")


#: A line without blanks at its ends, and DuckDB's forms of the fixed patterns of summaries.
_STRIPPED = r"regexp_replace({0}, '^[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_LINES = rf"l AS (SELECT doc_id, title, unnest(list_transform(regexp_split_to_array({BODY}, '\r?\n'), lambda x, i: {{'raw': x, 'pl': i}}), recursive := true) FROM documents), s AS (SELECT *, {_STRIPPED.format('raw')} AS line FROM l)"
_HEAD = r"regexp_replace(regexp_extract(line, '^#{2,3}\s+(.*)$', 1), '\s*#*\s*$', '')"
_OUTLINE = rf"""h AS (SELECT doc_id, pl, regexp_replace(regexp_replace({PLAIN.format(_HEAD)}, '^\d+(\.\d+)*[.、]?\s*', ''), '^\\\.\s*', '') AS head FROM s WHERE regexp_matches(line, '^#{{2,3}}\s+\S')),
f AS (SELECT doc_id, head, min(pl) AS pl FROM h WHERE head NOT IN ('', '附件', '相关笔记') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pl) AS place FROM f)"""


@query(f"""WITH {_LINES}, {_OUTLINE} SELECT d.doc_id, coalesce(string_agg(r.head, '；' ORDER BY r.pl), '') AS outline FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.place <= 4 GROUP BY 1""")
def outlines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.concat_ws("；", T.outline(T.body_of(F.col("text")))).alias("outline"))


_ADS = "(" + " + ".join(f"contains(p, '{w}')::INT" for w in T.ADVERTISING) + ")"
_NO_FRAME = " AND ".join(f"NOT regexp_matches(p, '{x}')" for x in T.FRAME_PATTERNS)
_ENDS = T.SENTENCE_ENDS


@query(rf"""WITH {_LINES}, {_OUTLINE}, p AS (SELECT *, {PLAIN.format('line')} AS p FROM s), q AS (SELECT *, rtrim(p, '。') AS said FROM p),
c AS (SELECT doc_id, min_by(p, pl) AS p FROM q WHERE length(p) >= 12 AND NOT regexp_matches(line, '{T.NO_PARAGRAPH}') AND NOT regexp_matches(raw, '{T.INDENTED}') AND {_NO_FRAME}
  AND NOT (contains(lower(p), 'offer') AND {_ADS} >= 1) AND {_ADS} < 2 AND NOT (contains(p, '关注') AND regexp_matches(p, '{T.FOLLOWED}'))
  AND NOT (length(said) % 2 = 1 AND length(said) // 2 BETWEEN 2 AND 40 AND left(said, length(said) // 2) = right(said, length(said) // 2) AND substr(said, length(said) // 2 + 1, 1) = ' ') GROUP BY 1),
t AS (SELECT doc_id, coalesce(nullif(regexp_extract(p, '^(.+?[{_ENDS}])', 1), ''), p) AS t FROM c),
o AS (SELECT doc_id, '本文目录包括' || string_agg('“' || head || '”', '、' ORDER BY pl) || '等内容。' AS o FROM r WHERE place <= 4 GROUP BY 1)
SELECT d.doc_id, CASE WHEN t IS NULL THEN '该笔记主要以图片形式呈现“' || d.title || '”相关内容。' ELSE CASE WHEN length(t) > 180 THEN rtrim(substr(t, 1, 180), '，,；;：:{_ENDS} ') || '。'
  WHEN regexp_matches(t, '[{_ENDS}]$') THEN t ELSE rtrim(t, '：:') || '。' END || coalesce(o, '') END AS summary FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN o ON d.doc_id = o.doc_id""")
def note_summaries(spark: SparkSession, d: str) -> DataFrame:
    """First sentence with content and the outline."""
    return docs(spark, d).select("doc_id", T.note_summary(F.col("text"), F.col("title")).alias("summary"))


@query(rf"""WITH {_LINES} SELECT d.doc_id, coalesce(min_by(substr(line, 1, 120), pl), '暂无摘要') AS first_line FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id AND line <> '' AND NOT regexp_matches(line, '^(#|!\[|>|---)') GROUP BY 1""")
def first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line by which a catalog announces each document."""
    return docs(spark, d).select("doc_id", T.first_effective_line(T.body_of(F.col("text"))).alias("first_line"))


def _rewritten(sql: str) -> str:
    steps = [(r"<\?xml[^?]*\?>", ""), ("<!DOCTYPE[^>]*>", ""), ("<en-note[^>]*>|</en-note>", ""), ("<br/?>", "\n"), ("<p[^>]*>", ""), ("</p>", "\n\n"), ("<li[^>]*>", "- "), ("</li>", "\n")]
    steps += [(f"(?s)<{t}[^>]*>(.*?)</{t}>", r"\1") for t in ("b", "strong", "i", "em", "u")] + [(f"(?s)<h{n}[^>]*>(.*?)</h{n}>", "#" * n + " \\1\n") for n in (1, 2, 3)]
    steps.append((r"""(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>""", r"[\2](\1)"))
    for pattern, to in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{to}', 'g')"
    for name, char in T.ENTITIES:
        sql = f"replace({sql}, '{name}', '" + char.replace("'", "''") + "')"
    return sql


@query(f"SELECT doc_id, {_STRIPPED.format('regexp_replace(r, chr(10) || ' + chr(39) + '{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')').replace('{3,}', '{3,}')} AS markdown FROM (SELECT doc_id, {_rewritten('coalesce(text, ' + chr(39) * 2 + ')')} AS r FROM documents)")
def plain_notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents' markup rewritten as plain Markdown."""
    return docs(spark, d).select("doc_id", T.plain_note(F.col("text")).alias("markdown"))


@query()
def normalized_titles(spark: SparkSession, d: str) -> DataFrame:
    """NFKC and case folding of titles, and whether the stored form agrees."""
    n = read(spark, d, "parsed_notes").select("guid", "title", "normalized_title").distinct()
    n = n.withColumn("made", T.normalized_title(F.col("title")))
    return n.select("guid", F.col("made").alias("normalized"), F.col("made").eqNullSafe(F.col("normalized_title")).alias("agrees"))


@query()
def markdown_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown of one form: markup converted, title heading dropped, headings from level 2 on."""
    made = M.normalise_column(F.coalesce(T.first_heading(T.body_of(F.col("text"))), F.col("title")), M.markdown_column(T.body_of(F.col("text"))))
    return docs(spark, d).select("doc_id", made.alias("markdown"))


@query()
def exact_visible_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text by a parser, and whether the JVM-side form agrees with it."""
    v = docs(spark, d).select("doc_id", M.parsed_text_column(F.col("text")).alias("parsed"), T.visible_text(F.col("text")).alias("native"))
    return v.select("doc_id", F.sha2("parsed", 256).alias("body_sha256"), (F.col("parsed") == F.col("native")).alias("agrees"))
