import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmill.operators import attachments, catalog, dedup, incremental, integrity, keywords, links, reclassify, registry, scoring

R = registry.load({"domains": {"A": {"core": ["alpha", "阿尔法"], "support": ["first", "one"], "support_only_min": 2}, "B": {"core": ["beta", "alpha"], "support": ["second"]}}, "aliases": {"old": "B"}})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def gate(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return scoring.gate_scores(scoring.term_matrix(docs, "id", F.col("text"), [t[4] for t in R.terms()]), R)


def test_registry_is_checked():
    for bad in ({"domains": {}}, {"domains": {"A": {"core": []}}}, {"domains": {"A": {"core": ["x", "x"]}}}, {"domains": {"A": {"core": ["x"]}}, "aliases": {"o": "Z"}}):
        with pytest.raises(ValueError):
            registry.load(bad)
    assert R.fingerprint(1) != R.fingerprint(2)


def test_gate(spark):
    s = {(r["id"], r["domain"]): (r["score"], r["eligible"]) for r in gate(spark, ["alpha", "alpha alpha Alpha alpha", "first one", "second", None, "", "beta second"]).collect()}
    assert s[(0, "A")] == (3, False)
    assert s[(1, "A")] == (9, True)
    assert s[(2, "A")] == (2, True)  # support alone, by support_only_min
    assert s[(3, "B")] == (1, False)
    assert not any(k[0] in (4, 5) for k in s)


def test_primary_domain_ties_and_limits(spark):
    p = {r["id"]: (r["domain"], r["matched"], r["reason"]) for r in scoring.primary_domain(gate(spark, ["alpha alpha", "beta beta alpha", "alpha alpha first"]), ["A"]).collect()}
    assert p[0] == ("", False, "tie")
    assert p[1] == ("B", False, "not allowed")
    assert p[2] == ("A", True, "primary")
    targets = spark.createDataFrame([(0, "A"), (1, "A"), (9, "B")], "id long, target string")
    g = {r["id"]: (r["matched"], r["reason"], r["competitor"]) for r in scoring.domain_gate(targets, gate(spark, ["alpha alpha", "beta beta"])).collect()}
    assert g[0] == (False, "tie", "B") and g[1] == (False, "too little", "B") and g[9] == (False, "too little", None)


def test_matrices_agree(spark):
    docs = spark.createDataFrame([(1, "Alpha alphabet 阿尔法阿尔法"), (2, None), (3, "")], "id long, text string")
    a = rows(scoring.term_matrix(docs, "id", F.col("text"), [t[4] for t in R.terms()]))
    assert a == rows(scoring.term_matrix_native(docs, "id", F.col("text"), R)) == [(1, "alpha", 1), (1, "阿尔法", 2)]
    assert scoring.term_matrix(docs.limit(0), "id", F.col("text"), ["x"]).count() == 0


def test_reclassify(spark):
    rules = reclassify.TitleRules(forced=(("B", "force"),), fallback=(("A", "hint"),))
    docs = spark.createDataFrame([(1, "force it", "A"), (2, "hint", "A"), (3, "nothing", "A"), (4, "x", "A"), (5, None, "B"), (6, "hint", "B")], "id long, title string, current string")
    body = spark.createDataFrame([(1, "beta beta beta"), (4, "beta beta beta 一"), (5, "beta")], "id long, text string")
    m = scoring.term_matrix(body, "id", F.col("text"), [t[4] for t in R.terms()], "wide")
    f = scoring.field_scores(m.limit(0), m, R)
    got = {r["id"]: (r["decision"], r["target"]) for r in reclassify.reclassify(docs, f, R, rules).collect()}
    assert got == {1: ("move", "B"), 2: ("keep", "A"), 3: ("unclassified", None), 4: ("unclassified", None), 5: ("unclassified", None), 6: ("move", "A")}


def test_keyword_union(spark):
    docs = spark.createDataFrame([(1, "AI助手", "sol"), (2, "training", "solution"), (3, None, "Memo LLM")], "id long, title string, body string")
    jobs, aliases = {"x": ["AI", "LLM"], "y": ["SOL", "memo"]}, {"SOL": ["llm"]}
    got = {r["id"]: r for r in keywords.keyword_union(docs, "id", F.lower(F.coalesce("title", F.lit(""))), F.lower("body"), jobs, aliases).collect()}
    assert got[1]["keyword_domain"] == "x" and got[1]["keywords"] == ["AI", "SOL"]  # a tie: the earlier domain
    assert not got[2]["matched"] and got[2]["keyword_domain"] is None
    assert got[3]["keyword_domain"] == "y" and got[3]["terms"] == ["LLM", "llm", "memo"]
    assert keywords.selection_hash(jobs, aliases) != keywords.selection_hash(dict(reversed(jobs.items())), aliases)
    assert [t[4] for t in keywords.expand({"d": ["Memo"]}, {"Memo": ["memo", "ＭＥＭＯ", "note"]})] == ["Memo", "note"]


NOTES = "guid string, title string, created long, updated long"


def test_freshest_is_order_independent(spark):
    data = [("a", "T", 1, 5), ("a", "T2", 1, 7), ("b", " T2　", 2, 7), ("c", "T2", 2, 7), ("d", None, None, None), ("a", "T2", 1, 7)]
    for n in (1, 3):
        df = spark.createDataFrame(data, NOTES).repartition(n)
        merged = dedup.rank_candidates(df, ["t2"])
        assert merged.count() == 4
        assert {r["title"]: r["guid"] for r in dedup.by_title(merged).collect()} == {"T2": "c", None: "d"}
    assert dedup.rank_candidates(df.limit(0), []).count() == 0


def test_gate_before_titles_before_limit(spark):
    df = spark.createDataFrame([("new", "T", 1, 9), ("old", "T", 1, 5), ("z", "Z", 1, 1)], NOTES)
    ok = spark.createDataFrame([("old",), ("z",)], "guid string")
    assert [r["guid"] for r in dedup.gate_then_dedup(dedup.rank_candidates(df, []), ok, 1).collect()] == ["old"]


def test_claims(spark):
    df = spark.createDataFrame([("a", "T", 1, 9, False), ("b", "T", 1, 5, True), ("c", "T ", 1, 4, True)], NOTES + ", ok boolean")
    assert {r["guid"]: r["outcome"] for r in dedup.claim_titles(df, F.col("ok")).collect()} == {"a": "rejected", "b": "accepted", "c": "duplicate_title"}


def test_paths(spark):
    df = spark.createDataFrame([("f", "n", "12345678-a"), ("f", "n", "12345678-b"), ("f", "n", "12345678-c"), ("g", "n", "x")], "folder string, name string, guid string")
    paths = [r["path"] for r in dedup.unique_paths(df, "folder", F.col("name"), "guid").orderBy("guid").collect()]
    assert paths[0] == "f/n.md" and paths[1] == "f/n_12345678.md" and len(set(paths)) == 4


def test_catalog(spark):
    old = spark.createDataFrame([("a", 1, "x", "t0"), ("a", 2, "y", "t1"), ("b", 1, "z", "t0"), (None, 1, "n", "t")], "guid string, v long, body string, first string")
    new = spark.createDataFrame([("a", 3, "w", "t9"), ("c", 1, "c", "t9"), ("c", 1, "c", "t9")], old.schema)
    assert rows(catalog.upsert(old, new, ["guid"], ["first"], ["v"])) == rows(spark.createDataFrame([("a", 3, "w", "t1"), ("b", 1, "z", "t0"), ("c", 1, "c", "t9"), (None, 1, "n", "t")], old.schema))
    once = catalog.upsert(old, new, ["guid"], ["first"], ["v"])
    assert rows(catalog.upsert(once, new, ["guid"], ["first"], ["v"])) == rows(once)
    assert catalog.upsert(old.limit(0), new.limit(0), ["guid"], ["first"], ["v"]).count() == 0
    cand = spark.createDataFrame([("a", 2), ("b", 7), ("q", 1), (None, 1)], "guid string, v long")
    assert {r["guid"]: r["state"] for r in catalog.lookup(cand, old, "guid", ["v"]).collect()} == {"a": "hit", "b": "stale", "q": "miss", None: "miss"}
    assert catalog.misses(cand, old, "guid", ["v"]).count() == 3


def test_incremental(spark):
    remote = spark.createDataFrame([("a", 5), ("b", 5), ("c", None), ("d", 1)], "guid string, updated long")
    local = spark.createDataFrame([("a", 4), ("a", 3), ("b", 5), ("c", 1)], "guid string, updated long")
    assert {r["guid"]: r["action"] for r in incremental.sync_plan(remote, local).collect()} == {"a": "update", "b": "skip", "c": "skip", "d": "new"}
    before = spark.createDataFrame([("p", "1", 1), ("q", "1", 1), ("r", "1", 1)], "path string, sha string, size long")
    after = spark.createDataFrame([("p", "1", 1), ("q", "2", 1), ("s", "1", 1)], before.schema)
    assert {r["path"]: r["change"] for r in incremental.changes(before, after).collect()} == {"q": "changed", "r": "removed", "s": "added"}


def test_references():
    text = "a [x](y (z).md \"t\") ![i](p.png) `[n](no)` [[W|alias]]\n```\n[c](no)\n```\n    [d](no)\n[![b](c.png)](d.md) [e](<f g.md>)"
    got = links.references(text)
    assert ("y (z).md", False, False) in got and ("p.png", True, False) in got and ("W|alias", False, True) in got
    assert ("d.md", False, False) in got and ("c.png", True, False) in got and ("f g.md", False, False) in got
    assert not any(t == "no" for t, _, _ in got)
    assert links.references(None) == [] == links.references("")


def test_resolution(spark):
    files = spark.createDataFrame([("d/a.md",), ("d/b.md",), ("e/b.md",), ("e/c.md",), (None,)], "path string")
    l = spark.createDataFrame([(1, "d/a.md", "b"), (2, "d/a.md", "e/c"), (3, "d/a.md", "c"), (4, "x/y.md", "b"), (5, "d/a.md", "zz"), (6, "d/a.md", "../x")], "src long, src_path string, target string")  # noqa: E741
    assert {r["src"]: r["reason"] for r in links.resolve(l, files).collect()} == {1: "relative", 2: "root", 3: "name", 4: "ambiguous", 5: "missing", 6: "outside"}
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "c"), ("a", "a")], "a string, b string")
    assert rows(links.one_sided(e)) == [("a", "c")]
    assert {r["kind"] for r in links.link_rules(e).collect()} == {"duplicate_link", "self_link"}


def test_checks(spark):
    docs = spark.createDataFrame([(1, "g", "A", "A/2024年01月/x.md", "T", dt.datetime(2024, 1, 1)), (2, "g", "A", "B/2024年01月/y.md", "T", None), (3, None, "B", None, " ", dt.datetime(2024, 1, 1))], "doc_id long, guid string, domain string, path string, title string, created timestamp")
    kinds = sorted(r["kind"] for r in integrity.metadata(docs).unionByName(integrity.duplicates(docs, "guid", "duplicate_guid")).collect())
    assert kinds == ["domain_mismatch", "duplicate_guid", "metadata_error", "metadata_error"]
    log = spark.createDataFrame([(1, "2024-01-01T00:00:00Z"), (2, "bad"), (3, "2023-12-31T00:00:00Z"), (4, "2024-01-01T08:00:00+08:00")], "pos long, t string")
    assert [r["problem"] for r in integrity.log_order(log, "pos", "t").orderBy("pos").collect()] == [None, "unreadable", "goes_back", "other_offset"]
    names = attachments.stored_names(spark.createDataFrame([("f", "a.png", "1" * 64), ("f", "a.png", "2" * 64), ("f", "a.png", "1" * 64)], "folder string, name string, sha string"))
    assert {r["stored"] for r in names.collect()} == {"a.png", "a_222222222222.png"}
    assert spark.range(1).select(attachments.url(F.lit("a b/ü+.png"))).collect()[0][0] == "a%20b/%C3%BC%2B.png"


def test_log_order_across_ranges(spark):
    """What is carried from range to range is the last readable entry, also over ranges that have none."""
    times = [None if 10 <= i < 40 else f"2024-01-{30 - i // 2 if i in (41, 57) else 1 + i // 3:02}T00:00:00{'+08:00' if i >= 51 else 'Z'}" for i in range(60)]
    log = spark.createDataFrame(list(enumerate(times)), "pos int, t string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = [r["problem"] for r in integrity.log_order(log, "pos", "t").orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    from datetime import datetime

    want, last = [], None
    for t in times:
        now = t and datetime.fromisoformat(t)
        want.append("unreadable" if not t else "goes_back" if last and now < last else "other_offset" if last and now.utcoffset() != last.utcoffset() else None)
        last = now or last
    assert got == want and {"unreadable", "goes_back", "other_offset", None} == set(want)
