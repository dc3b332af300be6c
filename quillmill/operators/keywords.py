"""Keyword union: canonical keywords with aliases by domain, and the documents that hold any of them."""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import has_term


def expand(domains: dict[str, list[str]], aliases: dict[str, list[str]]) -> list[tuple[str, int, str, int, str, int]]:
    """(domain, place, keyword, place, term, place): each keyword and its aliases; terms that are equal when NFKC-folded count once."""
    out = []
    for di, (domain, words) in enumerate(domains.items()):
        for ki, word in enumerate(dict.fromkeys(words)):
            seen = set()
            for term in (word, *aliases.get(word, ())):
                normal = unicodedata.normalize("NFKC", term).casefold()
                if normal not in seen:
                    seen.add(normal)
                    out.append((domain, di, word, ki, term, len(seen) - 1))
    return out


def expanded_frame(spark: SparkSession, domains: dict, aliases: dict) -> DataFrame:
    return spark.createDataFrame(expand(domains, aliases), "domain string, dom_ord int, keyword string, kw_ord int, term string, term_ord int")


def selection_hash(domains: dict[str, list[str]], aliases: dict[str, list[str]], version: int = 2) -> str:
    """Fingerprint of a selection; the order of the domains counts."""
    payload = {"version": version, "domains": [[d, list(k)] for d, k in domains.items()], "aliases": {k: list(aliases[k]) for k in sorted(aliases)}}
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def keyword_union(docs: DataFrame, id_col: str, title: Column, body: Column, domains: dict, aliases: dict) -> DataFrame:
    """(id, matched, keyword_domain, keywords, terms): title and body are NFKC-folded columns.

    The domain with the most matched keywords, the earlier on ties; keywords in the job's order; terms in order, once.
    Each keyword's test is an expression over the text, so nothing is joined or shuffled.
    """
    found = []
    for di, (domain, words) in enumerate(domains.items()):
        for word in dict.fromkeys(words):
            terms = [t for d, _, w, _, t, _ in expand({domain: [word]}, aliases)]
            hits = F.filter(F.array(*[F.when(has_term(title, t) | has_term(body, t), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
            found.append(F.struct(F.lit(di).alias("di"), F.lit(domain).alias("domain"), F.lit(word).alias("keyword"), hits.alias("terms")))
    slim = docs.select(F.col(id_col).alias("id"), F.filter(F.array(*found), lambda x: F.size(x["terms"]) > 0).alias("m"))
    def of(domain: str) -> Column:
        return F.size(F.filter("m", lambda x: x["domain"] == domain))

    counts = F.array(*[F.struct(of(domain).alias("n"), F.lit(-i).alias("late"), F.lit(domain).alias("domain")) for i, domain in enumerate(domains)])
    return slim.select(
        "id",
        (F.size("m") > 0).alias("matched"),
        F.when(F.size("m") > 0, F.array_max(counts)["domain"]).alias("keyword_domain"),
        F.transform("m", lambda x: x["keyword"]).alias("keywords"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["terms"]))).alias("terms"),
    )
