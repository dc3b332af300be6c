"""The pN_ queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.session import materialize

from . import copies, linkage, mixing, packing, spans, subjects, survivor, tokens, visual


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tables = [_read(spark, d, "parsed_notes"), _read(spark, d, "keyword_analyses")]
    return copies.copy_pairs(tables).select(F.col("first_id").alias("first_guid"), F.col("id").alias("guid"))


def p1_notes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each different note, with the number of its copies and of the rows that hold it."""
    groups, _, _ = copies.collapse_copies([_read(spark, d, "parsed_notes"), _read(spark, d, "keyword_analyses")])
    return groups.select(F.col("first_id").alias("guid"), F.col("n_ids").alias("n_copies"), "n_rows")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = visual.look_pairs(_read(spark, d, "parsed_notes"), "guid", "title")
    return pairs.select(F.col("id_a").alias("guid_a"), F.col("id_b").alias("guid_b"))


def p2_titles(spark: SparkSession, d: str) -> DataFrame:
    """Each note's title and normalized_title in the one form, the latter case folded."""
    notes = _read(spark, d, "parsed_notes").select("guid", "title", "normalized_title").distinct()
    notes = visual.one_form(notes, "title", "title_form")
    return visual.one_form(notes, "normalized_title", "normalized_form", fold_case=True).select("guid", "title_form", "normalized_form")


def _p4_assigned(spark: SparkSession, d: str) -> DataFrame:
    areas = [r["subject"] for r in _read(spark, d, "subject_areas").orderBy("ord").collect()]
    labels = _read(spark, d, "subject_labels")
    table = subjects.prepare(_read(spark, d, "parsed_notes"), labels, areas)
    return subjects.assign(table, subjects.fit(table, labels, areas))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4_assigned(spark, d).select(F.col("id").alias("guid"), "subject")


def p4_makeup(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's make-up: notes of each subject and their summed shares."""
    return _p4_assigned(spark, d).groupBy("subject").agg(F.count("*").alias("notes"), F.sum("weight").alias("weight"))


P5_FIELDS = ["summary", "canonical_path", "primary_domain"]


def _p5_groups(spark: SparkSession, d: str) -> DataFrame:
    notes = _read(spark, d, "parsed_notes").select("guid", "title", "updated_ms", "created_ms", "last_seen_at", "outcome", *P5_FIELDS)
    notes = notes.withColumns(
        {
            "group": survivor.title_group(F.col("title")),
            "updated": survivor.usable_time(F.col("updated_ms"), F.col("last_seen_at")),
            "created": survivor.usable_time(F.col("created_ms"), F.col("last_seen_at")),
            "trust": (F.col("outcome") == "accepted").cast("int"),
        }
    )
    return survivor.survivors(notes, "group", "guid", P5_FIELDS, ["updated", "created"], ["trust"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.found_rows(_p5_groups(spark, d), "guid", P5_FIELDS)


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The built records: one for each title, with the values themselves."""
    g = _p5_groups(spark, d)
    return g.select(F.col("group_id").alias("group_guid"), F.col("top_id").alias("guid"), "n_rows", *[F.col(f"{f}.value").alias(f) for f in P5_FIELDS])


def _p3_probe(spark: SparkSession, d: str, *kinds: str) -> linkage.Probe:
    """The accepted notes as history, all arrivals as the batches that follow each other."""
    notes = _read(spark, d, "parsed_notes").where(F.col("outcome") == "accepted")
    known = linkage.records(notes, F.concat(F.lit("note "), F.col("guid")), F.lit(-(1 << 62)), F.lit(0))
    arrivals = linkage.records(_read(spark, d, "incoming_notes"), F.col("arrival_id"), F.col("batch_no"), F.col("arrival_id"))
    return linkage.History(known, kinds).probe(arrivals)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3_probe(spark, d, "hash", "guid", "path").found().select(F.col("rid").cast("bigint").alias("arrival_id"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each arrival with the representative of its cluster, and the best score against a record known before it."""
    probe = _p3_probe(spark, d, "hash", "guid", "path")
    scored = probe.scored()
    links = scored.where("same").select(F.col("rid").alias("a"), F.col("known").alias("b"))
    own = probe.records.select(F.col("rid").alias("id"), F.col("rid").alias("rep"))
    best = scored.groupBy("rid").agg(F.max("score").alias("best_score"))
    mapping = linkage.update_representatives(own, links).join(probe.records.select(F.col("rid").alias("id")), "id", "left_semi")
    return mapping.join(best, mapping["id"] == best["rid"], "left").select(F.col("id").cast("bigint").alias("arrival_id"), F.col("rep").alias("representative"), "best_score")


def _token_sizes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(tokens.token_sizes(_read(spark, d, "documents"), "doc_id", "text", ["source"]), "token-sizes")


def _p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign_containers(_token_sizes(spark, d), _read(spark, d, "pack_capacities"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return _p6_packed(spark, d).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the fewest possible by total size, and the share of their room that is filled."""
    return packing.fill_report(_p6_packed(spark, d), _read(spark, d, "pack_capacities"))


def _p7_mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(_token_sizes(spark, d), _read(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p7_mix(spark, d).chosen().withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares really reached beside the targets."""
    return _p7_mix(spark, d).report()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(_read(spark, d, "documents"), min_span=150).pairs()


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    """Each document that shares spans, with the number of its characters that stand elsewhere too and their share."""
    docs = _read(spark, d, "documents")
    shared = spans.SharedSpans(docs, min_span=150).shared()
    sizes = docs.select(F.col("doc_id").alias("id"), "n_chars")
    return shared.join(sizes, "id").select(
        F.col("id").alias("doc_id"), "n_spans", "shared_chars", "longest", (F.col("shared_chars") / F.col("n_chars")).alias("share")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_notes, p2_found, p2_titles, p3_found, p3_clusters, p4_found, p4_makeup, p5_found, p5_records, p6_pack, p6_fill, p7_mix, p7_shares, p8_found, p8_shared)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """None of these can be said in SQL alone (Unicode normalisation, tokenizers, learned models); see tests/llm."""
    return {}
