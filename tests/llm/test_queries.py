"""The found queries over whole small tables, against what their definitions give by plain loops."""

import hashlib
import unicodedata
from collections import defaultdict

import pandas as pd

from quillmill.llm import copies, queries, survivor, visual


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(data, name, columns):
    return pd.read_parquet(f"{data}/{name}.parquet", columns=columns)


def test_p1_found(spark, data):
    groups = defaultdict(set)
    for name in ("parsed_notes", "keyword_analyses"):
        for guid, title, summary in table(data, name, ["guid", "title", "summary"]).itertuples(index=False):
            key = copies._digest(title, summary)
            if key:
                groups[key].add(guid)
    want = {(min(g), x) for g in groups.values() for x in g - {min(g)}}
    assert rows(queries.p1_found(spark, data)) == want and want
    assert queries.p1_notes(spark, data).count() == len(groups)


def test_p2_found(spark, data):
    looks = defaultdict(set)
    for guid, title in table(data, "parsed_notes", ["guid", "title"]).dropna().itertuples(index=False):
        if visual.look_form(title):
            looks[visual.look_form(title)].add((visual.stored_form(title), guid))
    want = {(a, b) for s in looks.values() for t, a in s for u, b in s if a < b and t != u}
    assert rows(queries.p2_found(spark, data)) == want and want
    assert queries.p2_titles(spark, data).where("title_form is not null").count() > 0


def test_p5_found(spark, data):
    """All rows of a title by layers of the skyline over filled fields, recency and trust, newest first within a layer."""
    from datetime import datetime

    fields = queries.P5_FIELDS
    notes = table(data, "parsed_notes", ["guid", "title", "updated_ms", "created_ms", "last_seen_at", "outcome", *fields])
    micros = lambda v: v * (10**6 if v < 10**11 else 1000 if v < 10**14 else 1)

    def usable(v, seen):
        t = datetime.fromisoformat(seen)
        return -1 if pd.isna(v) or v <= 0 or micros(int(v)) > (t.timestamp() * 10**6) else micros(int(v))

    groups = defaultdict(list)
    for r in notes.to_dict("records"):
        key = unicodedata.normalize("NFKC", r["title"] or "").casefold().strip()
        if key:
            fresh = (usable(r["updated_ms"], r["last_seen_at"]), usable(r["created_ms"], r["last_seen_at"]), r["guid"])
            full = {f"has_{f}": bool(r[f] and str(r[f]).strip()) for f in fields}
            groups[key].append({"recency": fresh, "trust": r["outcome"] == "accepted", "guid": r["guid"], **full})
    want = set()
    for rs in groups.values():
        if len({r["guid"] for r in rs}) > 1:
            order = [r for layer in survivor._layers(rs, ["recency", "trust", *[f"has_{f}" for f in fields]]) for r in sorted(layer, key=lambda r: r["recency"], reverse=True)]
            first = min(r["guid"] for r in rs)
            want.add((first, "guid", order[0]["guid"]))
            want |= {(first, f, next(r["guid"] for r in order if r[f"has_{f}"])) for f in fields if any(r[f"has_{f}"] for r in rs)}
    assert rows(queries.p5_found(spark, data)) == want and want


def test_p8_found(spark, data):
    where = defaultdict(set)
    for i, text in table(data, "documents", ["doc_id", "text"]).itertuples(index=False):
        for k in range(len(text or "") - 149):
            where[hashlib.blake2b(text[k : k + 150].encode(), digest_size=16).digest()].add(i)
    want = {(a, b) for s in where.values() if len(s) > 1 for a in s for b in s if a < b}
    assert rows(queries.p8_found(spark, data)) == want
    assert {r["doc_id"] for r in queries.p8_shared(spark, data).collect()} == {x for p in want for x in p}


def test_p6_and_p7(spark, data):
    packed = queries.p6_pack(spark, data).toPandas()
    room = table(data, "pack_capacities", ["capacity_id", "max_tokens"]).set_index("capacity_id")["max_tokens"]
    loads = packed.groupby(["capacity_id", "container"])["n_tokens"].sum().reset_index()
    assert (loads["n_tokens"] <= loads["capacity_id"].map(room)).all()
    assert packed.groupby("capacity_id")["n_tokens"].sum().nunique() == 1 and not packed.duplicated(["capacity_id", "doc_id", "piece"]).any()
    whole = packed.groupby(["capacity_id", "doc_id"]).agg(pieces=("piece", "count"), tokens=("n_tokens", "sum")).reset_index()
    assert (whole["pieces"] == (-(-whole["tokens"] // whole["capacity_id"].map(room))).clip(lower=1)).all()
    shares = queries.p7_shares(spark, data).toPandas()
    assert len(shares) == len(table(data, "mix_targets", ["source"])) and abs(shares["share"].sum() - 1) < 1e-9
