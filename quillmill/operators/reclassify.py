"""Reclassification: keep, move, ambiguous or unclassified, from weighted scores and ordered title rules.

The rules are a parameter; which title words stand for which domain is a matter of the collection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.registry import Registry


@dataclass(frozen=True)
class TitleRules:
    """Ordered (domain, pattern) lists: forced decides by itself, fallback hints; specific domains win over general ones.

    guarded: (domain, rival) for which strong body evidence keeps a note although its title hints at the rival.
    """

    forced: tuple = ()
    fallback: tuple = ()
    specific: frozenset = frozenset()
    guarded: tuple = ()


@dataclass(frozen=True)
class Limits:
    """Scores that decide."""

    strong: int = 8
    near_title: int = 5
    lead: int = 4
    body_lead: int = 8
    body_strong: int = 16
    body_cores: int = 3


def first_rule(title: Column, rules: tuple) -> Column:
    """Domain of the first pattern that the title matches, else null."""
    out = F.lit(None).cast("string")
    for domain, pattern in reversed(rules):
        out = F.when(title.rlike(pattern), F.lit(domain)).otherwise(out)
    return out


def all_rules(title: Column, rules: tuple) -> Column:
    return F.filter(F.array(*[F.when(title.rlike(p), F.lit(d)) for d, p in rules]) if rules else F.array().cast("array<string>"), lambda x: x.isNotNull())


def reclassify(docs: DataFrame, scores: DataFrame, registry: Registry, rules: TitleRules = TitleRules(), limits: Limits = Limits()) -> DataFrame:
    """(id, decision, target) for docs (id, title, current); scores as from scoring.field_scores().

    The highest of (title score, score, name) or of (score, name) is the target; what a title forces or hints, and how much stronger than
    the present domain the target is, decide between keeping and moving. One shuffle by id brings a
    document's scores, at most one for each domain, beside it.
    """
    entry = F.struct("score", "title_score", "body_score", "title_cores", "body_cores", "cores", "domain")
    grouped = scores.groupBy("id").agg(F.collect_list(entry).alias("s"))
    empty = F.array().cast(grouped.schema["s"].dataType)
    d = docs.join(grouped, "id", "left").withColumn("s", F.coalesce("s", empty))
    title = F.coalesce("title", F.lit(""))
    d = d.withColumns({"forced": first_rule(title, rules.forced), "hints": all_rules(title, rules.fallback), "hint": first_rule(title, rules.fallback)})

    def of(domain: Column, what: str) -> Column:
        return F.coalesce(F.get(F.filter("s", lambda x: x["domain"] == domain), F.lit(0))[what], F.lit(0))

    current = F.col("current")
    specific = sorted(rules.specific)
    top_title = F.coalesce(F.array_max(F.transform("s", lambda x: x["title_score"])), F.lit(0))
    by_title = F.array_max(F.transform("s", lambda x: F.struct(x["title_score"], x["score"], x["domain"])))["domain"]
    by_score = F.array_max(F.transform("s", lambda x: F.struct(x["score"], x["domain"])))["domain"]
    target = F.coalesce(F.col("forced"), F.when(top_title >= limits.strong, by_title).otherwise(by_score))
    d = d.withColumns({"top": top_title, "target_": target})
    d = d.withColumns(
        {
            **{f"c_{k}": of(current, k) for k in ("score", "title_score", "body_score", "body_cores")},
            **{f"t_{k}": of(F.col("target_"), k) for k in ("score", "title_cores", "cores")},
        }
    )
    free = F.col("forced").isNull() | (F.col("forced") == current)
    hinted = F.array_contains("hints", current)
    rival = F.exists("hints", lambda x: x.isin(specific) & (x != current)) if specific else F.lit(False)
    is_specific = current.isin(specific) if specific else F.lit(False)
    guarded = F.lit(False)
    for domain, other in rules.guarded:
        guarded = guarded | (
            (current == domain)
            & free
            & F.array_contains("hints", other)
            & (F.col("c_body_cores") >= limits.body_cores)
            & (F.col("c_body_score") >= limits.body_strong)
            & (F.col("c_body_score") >= of(F.lit(other), "body_score") + limits.body_lead)
        )
    near = ~rival & (F.col("c_title_score") >= F.col("top") - limits.near_title)
    strong_title = F.col("c_title_score") >= limits.strong
    stays = (
        guarded
        | (free & hinted & ((F.size("hints") == 1) | is_specific | near))
        | (free & is_specific & strong_title)
        | (free & strong_title & (F.col("c_title_score") == F.col("top")) & (is_specific | ~rival))
    )
    by_hint = F.when(F.col("hint") == current, "keep").when(F.col("hint").isNotNull(), "hint").otherwise("unclassified")
    title_backs = (F.col("t_title_cores") > 0) | F.array_contains("hints", F.col("target_"))
    c_strong = F.col("c_score") >= limits.strong
    what = (
        F.when(stays, "keep")
        .when(F.col("target_").isNull() | (F.col("t_score") < limits.strong) | (F.col("t_cores") == 0), by_hint)
        .when(F.col("target_") == current, "keep")
        .when(F.col("forced").isNotNull(), "move")
        .when(~title_backs & c_strong & (F.col("t_score") < F.col("c_score") + limits.body_lead), "keep")
        .when(~title_backs & (F.col("t_cores") < limits.body_cores), F.when(c_strong, "keep").otherwise(by_hint))
        .when(F.col("t_score") < F.col("c_score") + limits.lead, "ambiguous")
        .otherwise("move")
    )
    d = d.withColumn("what", what)
    return d.select(
        "id",
        F.when(F.col("what") == "hint", "move").otherwise(F.col("what")).alias("decision"),
        F.when(F.col("what") == "keep", current).when(F.col("what") == "hint", F.col("hint")).when(F.col("what") == "move", F.col("target_")).alias("target"),
    )
