import os

from quillmill.session import materialize, release_tables, shared_folder


def test_written_tables(spark):
    release_tables(spark)
    df = materialize(spark.range(10).selectExpr("id", "id % 3 AS k"), "some")
    empty = materialize(spark.range(0).selectExpr("id AS k", "cast(null AS string) AS s"), "none")
    assert df.count() == 10 and empty.count() == 0 and empty.dtypes == [("k", "bigint"), ("s", "string")]
    folder = os.path.join(shared_folder(spark).removeprefix("file://"), "tables")
    assert len([x for x in os.listdir(folder) if x.startswith(("some-", "none-"))]) >= 2
    assert release_tables(spark) == 2 and release_tables(spark) == 0
