"""References between documents: extraction, resolution and checks. Edges are rows; nothing is traversed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import strip

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_CODE = re.compile(r"(`+)(?:(?!\1).)*\1", re.S)
_WIKI = re.compile(r"(!?)\[\[([^\[\]\n]+)\]\]")


def _prose(text: str) -> str:
    """The text with fenced, indented and inline code taken out; line ends stay."""
    out, fence = [], None
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            out.append("")
        elif m:
            fence = m[1]
            out.append("")
        else:
            out.append("" if line.startswith(("    ", "\t")) else line)
    return _CODE.sub("", "\n".join(out))


def _target(text: str, at: int) -> tuple[str, int] | None:
    """The destination of an inline link whose '(' stands at at: balanced parentheses or <...>, without a title."""
    depth, i = 0, at
    while i < len(text) and text[i] != "\n":
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                inner = text[at + 1 : i].strip()
                if inner.startswith("<") and ">" in inner:
                    return inner[1 : inner.index(">")], i + 1
                return re.sub(r"""\s+("[^"]*"|'[^']*')$""", "", inner), i + 1
        i += 1
    return None


def references(text: str | None) -> list[tuple[str, bool, bool]]:
    """(target, is image, is wikilink) of each reference outside code, in order."""
    if not text or "[" not in text:
        return []
    prose = _prose(text.replace("\r\n", "\n"))
    found = [(m.start(), m[2], bool(m[1]), True) for m in _WIKI.finditer(prose)]
    taken = [(m.start(), m.end()) for m in _WIKI.finditer(prose)]
    i = prose.find("](")
    while i >= 0:
        if not any(a <= i < b for a, b in taken) and (got := _target(prose, i + 1)):
            open_at, depth = i, 0
            while open_at >= 0:
                depth += {"]": 1, "[": -1}.get(prose[open_at], 0)
                if not depth:
                    break
                open_at -= 1
            if open_at >= 0 and got[0]:
                found.append((open_at, got[0], prose[open_at - 1 : open_at] == "!", False))
        i = prose.find("](", i + 2)
    return [(t, image, wiki) for _, t, image, wiki in sorted(found)]


def edges(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = []) -> DataFrame:
    """(src, n, target, is_image, is_wikilink, keep...) for each reference; documents without any give none."""

    @F.pandas_udf("array<struct<target:string,is_image:boolean,is_wikilink:boolean>>")
    def refs(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"target": t, "is_image": i, "is_wikilink": w} for t, i, w in references(x)] for x in texts])

    rows = docs.where(F.col(text_col).contains("](") | F.col(text_col).contains("[["))
    rows = rows.select(F.col(id_col).alias("src"), *keep, F.posexplode(refs(F.col(text_col))).alias("n", "r"))
    return rows.select("src", "n", "r.target", "r.is_image", "r.is_wikilink", *keep)


def edges_native(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(src, target, is_image) of the regular inline links, without Python: no nesting, code or wikilinks."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"(!?\[[^\]]*\]\([^)\s]+\))"), F.lit(1))
    rows = docs.select(F.col(id_col).alias("src"), F.explode(found).alias("raw"))
    return rows.select("src", F.regexp_extract("raw", r"\(([^)]+)\)$", 1).alias("target"), F.col("raw").startswith("!").alias("is_image"))


def wikilink_target(raw: Column) -> Column:
    """Without alias and anchor; '#' inside a name that ends in .md stays."""
    name = strip(F.split_part(raw, F.lit("|"), F.lit(1)))
    return F.when(F.lower(name).endswith(".md"), name).otherwise(F.regexp_replace(name, r"#.*$", ""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?i)\.md$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


#: A file name with an ending: a dot that is neither its first nor its last character.
_ENDING = r"[^/]\.[^./]+$"


def decoded(target: Column) -> Column:
    """Forward slashes, percent signs decoded; a target that can't be decoded stays as it is."""
    t = F.regexp_replace(target, r"\\", "/")
    return F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (src, src_path, target) with resolved and reason, against files (path).

    Targets are decoded, and one without an ending means a .md file. Tried in turn: beside the source, from the root, and, for a bare name
    without folders and ending only, the unique document of that name. reason: relative, root, name, ambiguous, missing, outside. Null targets are missing.
    """
    paths = files.select("path").where("path is not null").distinct()
    t = decoded(F.col("target"))
    out = links.withColumn("_t", t).withColumn("_ending", F.coalesce(F.col("_t").rlike(_ENDING), F.lit(False)))
    with_md = F.when(F.col("_ending"), F.col("_t")).otherwise(F.concat("_t", F.lit(".md")))
    beside = F.when(folder(F.col("src_path")) == "", with_md).otherwise(F.concat_ws("/", folder(F.col("src_path")), with_md))
    bare = ~F.col("_t").contains("/") & ~F.col("_ending")
    outside = F.coalesce(F.col("_t").rlike(r"(^|/)\.\.(/|$)|^/"), F.lit(False))
    out = out.withColumns({"_beside": beside, "_root": with_md, "_stem": F.when(bare, F.col("_t")), "_outside": outside})
    out = out.join(paths.select(F.col("path").alias("_beside"), F.lit(True).alias("_r")), "_beside", "left")
    out = out.join(paths.select(F.col("path").alias("_root"), F.lit(True).alias("_o")), "_root", "left")
    names = paths.where(F.lower("path").endswith(".md")).groupBy(stem(F.col("path")).alias("_stem")).agg(F.count("*").alias("_n"), F.min("path").alias("_only"))
    out = out.join(names, "_stem", "left")
    reason = F.when(F.col("_outside"), "outside").when(F.col("_r"), "relative").when(F.col("_o"), "root").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    out = out.withColumn("reason", reason)
    resolved = F.when(F.col("reason") == "relative", F.col("_beside")).when(F.col("reason") == "root", F.col("_root")).when(F.col("reason") == "name", F.col("_only"))
    return out.withColumn("resolved", resolved).select(*links.columns, "resolved", "reason")


def one_sided(links: DataFrame) -> DataFrame:
    """Edges (a, b) without (b, a), each once; self links are none."""
    e = links.where("a <> b").select("a", "b").distinct()
    return e.join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")


def orphans(docs: DataFrame, links: DataFrame) -> DataFrame:
    """docs (path) that no resolved link points at."""
    return docs.join(links.where("resolved is not null").select(F.col("resolved").alias("path")), "path", "left_anti")


def few_sources(docs: DataFrame, links: DataFrame) -> DataFrame:
    """docs (path, least) with fewer than least different resolved sources in links (a, resolved), with the number n they have."""
    have = links.where("resolved is not null").groupBy(F.col("a").alias("path")).agg(F.count_distinct("resolved").alias("_n"))
    return docs.join(have, "path", "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n").where(F.col("n") < F.col("least"))


def link_rules(links: DataFrame, most: int = 3) -> DataFrame:
    """(a, kind, detail) for repeated, self and too many links of a source (a, b)."""
    per = links.groupBy("a", "b").agg(F.count("*").alias("n"))
    twice = per.where("n > 1").select("a", F.lit("duplicate_link").alias("kind"), F.col("b").alias("detail"))
    own = per.where("a = b").select("a", F.lit("self_link").alias("kind"), F.col("b").alias("detail"))
    many = per.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > most).select("a", F.lit("too_many_links").alias("kind"), F.col("n").cast("string").alias("detail"))
    return twice.unionByName(own).unionByName(many)


def link_block(links: DataFrame) -> DataFrame:
    """(a, block): the sorted links of a source as a controlled block."""
    lines = F.array_sort(F.collect_set(F.concat(F.lit("- [["), "b", F.lit("]]"))))
    return links.where("a <> b").groupBy("a").agg(F.concat_ws("\n", F.array(F.lit("<!-- links:start -->")), lines, F.array(F.lit("<!-- links:end -->"))).alias("block"))
