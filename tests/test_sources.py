import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.sources import readers
from quillmill.streaming import sync


def test_markdown_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("AI/2024年01月/a b.md", '---\nsource_guid: "g"\ncreated: 2024-01-02 03:04:05\ndomain: AI\n---\n\n# Head\n'), (".git/x.md", "no"), ("u+v.md", "plain")], "path string, text string")
    root = str(tmp_path / "vault")
    (tmp_path / "vault").mkdir()
    assert readers.export_markdown(docs, root).where("written").count() == 3
    assert readers.export_markdown(docs, root).where("written").count() == 0
    back = {r["path"]: r for r in readers.documents(readers.markdown_tree(spark, root)).collect()}
    assert set(back) == {"AI/2024年01月/a b.md", "u+v.md"}
    assert back["AI/2024年01月/a b.md"]["title"] == "Head" and back["AI/2024年01月/a b.md"]["guid"] == "g" and back["u+v.md"]["title"] == "u+v"
    with pytest.raises(Exception, match="leaves the root"):
        readers.export_markdown(spark.createDataFrame([("../x.md", "t")], docs.schema), root).count()


def test_partitions_are_replaced_alone(spark, tmp_path):
    df = readers.documents(spark.createDataFrame([("a.md", "---\ncreated: 2024-01-02 00:00:00\ndomain: AI\n---\nx"), ("b.md", "---\ncreated: 2024-02-02 00:00:00\ndomain: AI\n---\ny")], "path string, text string")).drop("fields")
    readers.write_documents(df, str(tmp_path / "t"))
    readers.write_documents(df.where("path = 'a.md'"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_jobs(spark):
    job = readers.load_job('{"since": "2024-01-01", "until": "2024-02-01", "domains": {"AI": {"keywords": ["x", "x", " y "]}}, "aliases": {"x": ["z"]}}', ["AI"])
    assert job["domains"] == {"AI": ["x", "y"]} and len(readers.job_id(job)) == 16
    for bad in ('{"since": "2024-01-01", "until": "2024-01-01", "domains": {}}', '{"since": "2024-01-01", "since": "2024-01-02"}', '{"since": "2024-01-01", "until": "2024-02-01", "domains": {"Q": {"keywords": ["x"]}}}'):
        with pytest.raises(ValueError):
            readers.load_job(bad, ["AI"])
    d = readers.decisions(spark, '{"moves": {"a": "AI"}, "trash": ["b"], "links": {"a": ["b", "c"]}}')
    assert d["links"].count() == 2
    assert readers.page_ranges(600, 250) == [(0, 250), (250, 250), (500, 100)] and readers.page_ranges(0) == []


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("a.md", "x")
        z.writestr("../b.md", "y")
    got = {r["path"]: r["problem"] for r in readers.zip_members(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {"a.md": None, "../b.md": "unsafe"}


def test_streaming_upsert(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "guid string, v long, first string"
    spark.createDataFrame([("a", 1, "t0")], schema).write.parquet(f"{table}-0")
    spark.createDataFrame([("a", 2, "t1"), ("b", 1, "t1")], schema).write.parquet(src)
    state = {"at": f"{table}-0"}

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{table}-{number + 1}")
        state["at"] = f"{table}-{number + 1}"

    q = sync.sync_catalog(spark.readStream.schema(schema).parquet(src), lambda: spark.read.parquet(state["at"]), write, str(tmp_path / "cp"), ["guid"], ["first"], ["v"])
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(state["at"]).collect())) == [("a", 2, "t0"), ("b", 1, "t1")]
    hits = spark.createDataFrame([("g", 1, "k"), ("g", 1, "k")], "guid string, updated long, search_keyword string").withColumn("pulled_at", F.lit("2024-01-01").cast("timestamp"))
    assert sync.hits_per_window(hits).collect()[0]["hits"] == 2
