"""One stored form for text that looks the same (problem 2).

look_form() maps every text to the form by which texts that a reader cannot tell apart compare equal;
stored_form() is the text itself without differences in ordinary blanks. Nulls stay null, and an empty
text stays empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like a Latin letter, each group in the same order as its Latin row.
LOOKALIKE_ROWS = [
    # Cyrillic
    ("АВЕЅІЈКМНОРСТХУԚԜѴԌаеѕіјорсухһԁԛԝӏѵ", "ABESIJKMHOPCTXYQWVGaesijopcyxhdqwlv"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳνοϲαγιρσυ", "ABEZHIKMNOPTYXCjvocayipou"),
    # Coptic and Cherokee
    ("ⲞⲟⲤⲥⲢⲣⲎⲒⲔⲘⲚⲦⲨⲬ", "OoCcPpHIKMNTYX"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPRSTVWZ"),
    # Armenian
    ("ՍՕՏոսօհցզ", "UOSnuohgq"),
    # Letter-like forms without a compatibility mapping
    ("ıɡɑꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "igaBPdDTGKJCZFMNLSRVHWXYAEIOU"),
    # Hyphens that look like the plain one
    ("\u2010\u2011\u2012\u2043\u2212\u02d7", "------"),
    # Small capitals of letters whose small form has the same shape
    ("ᴄᴏꜱᴜᴠᴡᴢ", "cosuvwz"),
    # Katakana that look like Han characters
    ("カエロニハタトセチメ", "力工口二八夕卜七千乄"),
]
LOOKALIKES = {ord(a): b for other, latin in LOOKALIKE_ROWS for a, b in zip(other, latin)}

#: Compatibility forms of these kinds look different from what they stand for.
DISTINCT_KINDS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")


#: Parts over which the rows of one look are spread before looks of one stored form are dropped.
SPREAD = 8


def _default_ignorable(cp: int) -> bool:
    """Characters without a visible sign of their own."""
    if cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        return True
    if 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp <= 0xE0FFF:
        return True
    return unicodedata.category(chr(cp)) == "Cf" and not 0x0600 <= cp <= 0x0605


def _char_class(test) -> str:
    """A regular-expression class of all code points that pass the test."""
    ranges, start = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and test(cp)
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            ranges.append((start, cp - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a != b else f"\\U{a:08x}" for a, b in ranges)


_ordinary = re.compile(r"[ \t\r\n\x0b\x0c]+")
_blank = re.compile(r"\s+")
_ignorable_pattern: re.Pattern | None = None


def _ignorables() -> re.Pattern:
    """Compiled once in each process."""
    global _ignorable_pattern
    if _ignorable_pattern is None:
        _ignorable_pattern = re.compile(f"[{_char_class(_default_ignorable)}]")
    return _ignorable_pattern


class _Compatibility(dict):
    """Translation table that is filled as characters are met."""

    def __missing__(self, cp: int) -> str:
        char = chr(cp)
        kind = unicodedata.decomposition(char)
        if kind.startswith(DISTINCT_KINDS):
            to = char
        else:
            to = unicodedata.normalize("NFKC", char)
        self[cp] = to
        return to


_compatibility = _Compatibility()


def stored_form(text: str) -> str:
    """The characters as stored; ordinary blanks at the ends or repeated count for nothing."""
    return _ordinary.sub(" ", text).strip(" ")


def look_form(text: str, fold_case: bool = False) -> str:
    """The form in which texts that look the same are equal.

    Default-ignorable characters go, compatibility forms of the same sign become that sign (raised and
    circled digits and fractions look different and stay), the rest is composed, look-alike letters
    become Latin, any blank becomes a space. fold_case adds full case folding for comparisons beyond the look.
    """
    if text.isascii():
        form = text
    else:
        form = _ignorables().sub("", text).translate(_compatibility)
        form = unicodedata.normalize("NFC", form).translate(LOOKALIKES)
        # a look-alike base letter may now compose with the accent behind it
        form = unicodedata.normalize("NFC", form)
    if fold_case:
        form = unicodedata.normalize("NFC", form.casefold())
    return _blank.sub(" ", form).strip(" ")


def _per_distinct(values: pd.Series, function) -> pd.Series:
    """Apply function once to each distinct value of the batch."""
    codes, uniques = pd.factorize(values)
    forms = pd.Series([function(x) for x in uniques] + [None], dtype=object)
    return pd.Series(forms.to_numpy()[codes], index=values.index)


def look_column(text: Column, fold_case: bool = False) -> Column:
    """look_form() of a column, vectorised per distinct value; null for null."""

    @F.pandas_udf("string")
    def look(values: pd.Series) -> pd.Series:
        return _per_distinct(values, lambda x: look_form(x, fold_case))

    return look(text)


def stored_column(text: Column) -> Column:
    """stored_form() of a column, JVM-side; null for null."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\x0B\x0C]+", " "))


def look_pairs(df: DataFrame, id_col: str, text_col: str, rows_per_salt: int = 5000) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, whose texts look the same but are stored in other characters.

    Ids may repeat, and each of an id's texts counts. Null ids and null or blank texts take no part. Forms that are
    stored in one way only are dropped before the join by a pre-aggregated minimum and maximum, so most
    rows never reach it; what is left is joined by look, each look split over as many salts as its size asks for.
    """
    forms = (
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where(F.col("id").isNotNull() & F.col("text").isNotNull())
        .select("id", stored_column(F.col("text")).alias("stored"))
        .distinct()
        .select("id", "stored", look_column(F.col("stored")).alias("look"))
        .where(F.col("look") != "")
    )
    varied = (
        forms.groupBy("look")
        .agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"), F.count("*").alias("n"))
        .where(F.col("lo") != F.col("hi"))
        .select("look", F.ceil(F.col("n") / rows_per_salt).cast("int").alias("salts"))
    )
    # looks of one form only, such as an untitled note's, leave here: spread by id, so that none of them is a hot key
    spread = varied.select("look", "salts", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    kept = forms.withColumn("spread", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).join(spread, ["look", "spread"]).drop("spread")
    left = kept.select(
        "look", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("id_a"), F.col("stored").alias("stored_a")
    )
    right = kept.select(
        "look", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("id_b"), F.col("stored").alias("stored_b")
    )
    return (
        left.join(right, ["look", "salt"])
        .where((F.col("id_a") < F.col("id_b")) & (F.col("stored_a") != F.col("stored_b")))
        .select("id_a", "id_b")
        .distinct()
    )


def one_form(df: DataFrame, text_col: str, out_col: str = "look", fold_case: bool = False) -> DataFrame:
    """df with out_col: the one consistent form of text_col. Null gives null, blank gives ''."""
    return df.withColumn(out_col, look_column(F.col(text_col), fold_case))
