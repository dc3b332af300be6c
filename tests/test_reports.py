from pyspark.sql import functions as F

from quillmill.operators import reports


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_three_states(spark):
    s = lambda r: spark.createDataFrame(r, "path string, sha string")
    got = reports.three_way(s([("a", "1"), ("b", "1"), ("c", None), (None, "1")]), s([("a", "1"), ("b", "2"), ("c", None), ("d", "1")]), s([("a", "1"), ("b", "1"), ("c", None), ("e", "1")]))
    assert rows(got) == [("a", "same"), ("b", "sha_differs"), ("c", "same"), ("d", "not_in_manifest"), ("e", "not_in_manifest")]
    assert reports.three_way(*[s([])] * 3).count() == 0


def test_later_runs_count(spark):
    e = lambda r: spark.createDataFrame(r, "path string, sha string, reason string")
    got = reports.latest_entries([e([("a", "1", "x"), ("b", "1", "x"), ("b", "1", "y")]), e([("a", "1", "z"), ("a", "2", None)])], ["path", "sha"])
    assert rows(got) == [("a", "1", 1, "z"), ("a", "2", 1, None), ("b", "1", 0, "y")]


def test_numbers_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), "id").repartition(5)
    got = {r["id"]: r["place"] for r in reports.numbered(df, F.desc("k"), "id").collect()}
    want = sorted(range(500), key=lambda i: (-(i * 37 % 101), i))
    assert got == {i: n + 1 for n, i in enumerate(want)}
    assert reports.numbered(df.limit(0), F.col("k")).count() == 0


def test_severities_and_totals(spark):
    found = spark.createDataFrame([("ORPHAN_KNOWLEDGE_NOTE", "A"), ("INDEX_DRIFT", None)], "kind string, domain string")
    assert rows(reports.severities(reports.with_severity(found))) == [(1, 1, False)]
    assert rows(reports.severities(reports.with_severity(found.limit(0)))) == [(0, 0, True)]
    articles = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "domain string")
    assert rows(reports.totals(articles, found)) == [("A", 2, 1), ("B", 1, 0), (None, 1, 1)]


def test_domains_and_paths(spark):
    paths = spark.createDataFrame([("Z/2024年01月/a.md",), ("B/x.md",), ("A/x.md",), ("README.md",), (None,)], "path string")
    assert rows(reports.known_domains(["Z", "Q", "Z"], paths)) == [("A", 3), ("B", 4), ("Q", 2), ("Z", 1)]
    p = spark.createDataFrame([("Z/2024年01月/a.md",), ("Z/2024年13月/a.md",), ("Y/2024年01月/a.md",), ("Z/2024年01月/a\\b.md",), (None,)], "path string")
    assert [r[0] for r in p.select(reports.valid_decision_path(F.col("path"), ["Z"])).collect()] == [True, False, False, False, False]


def test_sections_and_renames(spark):
    one = lambda text, names, make: spark.createDataFrame([(text, names)], "t string, n array<string>").select(make(F.col("t"), F.col("n"))).collect()[0][0]
    section = one("see ![](_attachments/a%20b.png)", ["a b.png", "c[1].pdf", "d.JPG", "d.JPG"], reports.attachment_section)
    assert section == "\n---\n\n## 附件\n\n- [c\\[1\\].pdf](_attachments/c%5B1%5D.pdf)\n![d.JPG](_attachments/d.JPG)"
    assert one("_attachments/a", ["a"], reports.attachment_section) == "" == one("x", [], reports.attachment_section)
    assert one(None, ["a"], reports.attachment_section).endswith("- [a](_attachments/a)")
    text = '---\ntitle: Old/x\ndomain: "Old"\n---\n[a](Old/p.md) [[Old/q|Old]] domain: Old\n'
    assert one(text, [], lambda t, n: reports.renamed(t, {"Old": "New"})) == '---\ntitle: Old/x\ndomain: "New"\n---\n[a](New/p.md) [[New/q|Old]] domain: Old\n'


def test_complete(spark):
    refs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None)], "doc_id long, target string")
    assert rows(reports.complete(refs, spark.createDataFrame([("a",)], "path string"))) == [(1, 2, False), (2, 2, True), (3, 1, False)]
