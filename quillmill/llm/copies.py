"""Copies hidden by formatting (problem 1).

canonical() reduces a text to its letters, digits and meaning-bearing signs; a list of labelled fields
becomes its sorted fields. Records with equal canonical keys are copies.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.session import materialize

from .visual import _default_ignorable

#: Compatibility letters that case folding would turn into the letter they look like: long s, ohm, kelvin, angstrom, ligatures.
_PROTECTED_LETTERS = "\u017f\u2126\u212a\u212b\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06"
_PROTECTED = {ord(c): chr(0xE100 + i) for i, c in enumerate(_PROTECTED_LETTERS)}
_protect = re.compile(f"[{_PROTECTED_LETTERS}]")

#: Signs that change a name or a number, each with the place where it does so, become characters of the private use area.
_SIGNS = [
    ("+", re.compile(r"(?<=[^\W_])(\++)"), lambda m: "\ue001" * len(m[1])),  # C++, A+
    ("#", re.compile(r"(?<=[^\W\d_])#"), "\ue002"),  # C#
    (".", re.compile(r"(?<=\d)\.(?=\d)"), "\ue003"),  # 1.5
    (",", re.compile(r"(?<=\d),(?=\d{3}(?!\d))"), ""),  # thousands
    (",", re.compile(r"(?<=\d),(?=\d)"), "\ue004"),  # 1,5
    ("/", re.compile(r"(?<=\d)/(?=\d)"), "\ue005"),  # 1/2
    ("-", re.compile(r"(?:(?<=\s)|^)-(?=\d)"), "\ue006"),  # -5
    ("\u2212", re.compile(r"(?:(?<=\s)|^)\u2212(?=\d)"), "\ue006"),
    ("%", re.compile(r"(?<=\d)\s?%"), "\ue007"),
    ("\uff05", re.compile(r"(?<=\d)\s?\uff05"), "\ue007"),
    ("\u2030", re.compile(r"(?<=\d)\s?\u2030"), "\ue008"),
    ("\u00b0", re.compile(r"(?<=\d)\s?\u00b0"), "\ue009"),
    ("\u2103", re.compile(r"(?<=\d)\s?\u2103"), "\ue00a"),
    ("\u2109", re.compile(r"(?<=\d)\s?\u2109"), "\ue00b"),
    ("$", re.compile(r"\$(?=\s?\d)"), "\ue010"),
    ("\u20ac", re.compile("\u20ac(?=\\s?\\d)"), "\ue011"),
    ("\u00a3", re.compile("\u00a3(?=\\s?\\d)"), "\ue012"),
    ("\u00a5", re.compile("\u00a5(?=\\s?\\d)"), "\ue013"),
    ("\uffe5", re.compile("\uffe5(?=\\s?\\d)"), "\ue014"),
    ("&", re.compile(r"(?<=[a-z])&(?=[a-z])"), "\ue015"),  # R&D
]
_no_word = re.compile(r"[\W_]+")


def _kept(char: str) -> bool:
    """Besides letters and digits: accents, Han radicals and the signs above."""
    cp = ord(char)
    if 0x2E80 <= cp <= 0x2FDF or 0xE001 <= cp <= 0xE1FF:
        return True
    return unicodedata.category(char) in ("Mn", "Mc") and not _default_ignorable(cp)


class _Runs(dict):
    """What stays of a run of characters that are no letters, remembered for the runs met first."""

    def __missing__(self, run: str) -> str:
        stays = "" if run.isascii() else "".join(c for c in run if _kept(c))
        if len(self) < 50_000:
            self[run] = stays
        return stays


_runs = _Runs()


def canonical(text: str | None) -> str:
    """Letters and digits of a text in order, case folded, with the signs that change a name or a number."""
    if not text:
        return ""
    if not text.isascii() and _protect.search(text):
        text = text.translate(_PROTECTED)
    text = text.casefold()
    for sign, pattern, to in _SIGNS:
        if sign in text:
            text = pattern.sub(to, text)
    return _no_word.sub(lambda m: _runs[m[0]], text)


_split = re.compile(r"\s*[\n\r|;；]\s*")
_label = re.compile(r"^[^\w]*([^\W\d_]+(?:[ _][^\W\d_]+){0,2})\s*[:：](.*)$", re.S)


def fields_of(text: str | None) -> list[tuple[str, str]] | None:
    """(label, value) of a list of labelled fields in its order, else None.

    A text is such a list if it has at least two parts, parted by line ends, bars or semicolons, that all
    start with a label of up to three words and a colon.
    """
    if not text or ":" not in text and "：" not in text:
        return None
    parts = [x for x in _split.split(text.strip()) if x.strip()]
    if len(parts) < 2:
        return None
    found = []
    for part in parts:
        m = _label.match(part)
        if not m or len(m[1]) > 30:
            return None
        found.append((m[1], m[2]))
    return found


def canonical_text(text: str | None) -> str:
    """canonical(), where the order of labelled fields counts for nothing and each value stays with its label."""
    found = fields_of(text)
    if found is None:
        return canonical(text)
    return "\x1e".join(sorted(f"{canonical(a)}\x1f{canonical(b)}" for a, b in found))


def _digest(title: str | None, summary: str | None) -> bytes | None:
    if not title or not title.strip():
        return None
    head = canonical(title)
    if not head:  # a title of signs only: these are all it has
        head = "\x1d" + "".join(title.split())
    return hashlib.blake2b(f"{head}\x1c{canonical_text(summary)}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def canonical_key(title: Column, summary: Column) -> Column:
    """16 bytes that are equal for copies; null for a blank title."""

    @F.pandas_udf("binary")
    def key(titles: pd.Series, summaries: pd.Series) -> pd.Series:
        return pd.Series([_digest(a, b) for a, b in zip(titles, summaries)], index=titles.index, dtype=object)

    return key(title, summary)


def collapse_copies(
    tables: list[DataFrame], id_col: str = "guid", title_col: str = "title", summary_col: str = "summary", hot_share: float = 1 / 256, salts: int = 64
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, members, hot) of records whose title and summary say the same.

    groups: canonical_key, first_id, n_ids (different ids), n_rows. members: canonical_key, id, once each, n rows.
    Hot keys, those with more than hot_share of the members, are found exactly from partial counts; there are fewer
    than 1 / hot_share of them at any size. They are aggregated in two levels over salts, the others in one.
    Null ids and blank titles take no part; null and blank summaries are equal. The representative is the smallest id.
    """
    rows = reduce(DataFrame.unionByName, [t.select(F.col(id_col).alias("id"), F.col(title_col).alias("t"), F.col(summary_col).alias("s")) for t in tables])
    keyed = rows.where(F.col("id").isNotNull()).select("id", canonical_key(F.col("t"), F.col("s")).alias("canonical_key")).where(F.col("canonical_key").isNotNull())
    # the shuffle key is (key, id): spread however hot a key is, and row copies vanish before it
    members = materialize(keyed.groupBy("canonical_key", "id").agg(F.count("*").alias("n")), "copies")
    hot = hot_keys(members, "canonical_key", hot_share)
    single = [F.min("id").alias("first_id"), F.count("*").alias("n_ids"), F.sum("n").alias("n_rows")]
    totals = [F.min("first_id").alias("first_id"), F.sum("n_ids").alias("n_ids"), F.sum("n_rows").alias("n_rows")]
    of_hot = (
        members.join(F.broadcast(hot), "canonical_key", "left_semi")
        .groupBy("canonical_key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
        .agg(*single)
        .groupBy("canonical_key")
        .agg(*totals)
    )
    of_rest = members.join(F.broadcast(hot), "canonical_key", "left_anti").groupBy("canonical_key").agg(*single)
    return of_hot.unionByName(of_rest), members, hot


def hot_keys(members: DataFrame, key: str, hot_share: float) -> DataFrame:
    """Keys with more than hot_share of all rows: fewer than 1 / hot_share, counted exactly from partial counts."""
    bound = max(2.0, hot_share * members.count())
    found = members.groupBy(key).agg(F.count("*").alias("k")).where(F.col("k") > bound).select(key).collect()
    return members.sparkSession.createDataFrame([tuple(r) for r in found], members.select(key).schema)


def copy_pairs(tables: list[DataFrame], hot_share: float = 1 / 256, **columns: str) -> DataFrame:
    """(first_id, id): each record that is a copy, with the smallest id of its group. See collapse_copies()."""
    groups, members, hot = collapse_copies(tables, hot_share=hot_share, **columns)
    first = groups.where(F.col("n_ids") > 1).select("canonical_key", "first_id")
    # groups of hot keys are few and go to every task; the others meet their members in one shuffle by key
    of_hot = members.join(F.broadcast(first.join(F.broadcast(hot), "canonical_key", "left_semi")), "canonical_key")
    of_rest = members.join(F.broadcast(hot), "canonical_key", "left_anti").join(first, "canonical_key")
    return of_hot.unionByName(of_rest).where(F.col("id") != F.col("first_id")).select("first_id", "id").distinct()
