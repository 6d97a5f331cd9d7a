from pyspark.sql import functions as F

from lamina.sources import patch_files, text_tables
from lamina.streaming import appended


def pp(spark, n=5):
    rows = [(p, x, y, 4.0 * x, 4.0 * y, 10.0 * p) for p in range(n) for x in range(-2, 3) for y in range(-2, 3)]
    return spark.createDataFrame(rows, patch_files.SCHEMA)


def test_patch_files_round_trip_and_pruning(spark, tmp_path):
    df = pp(spark)
    assert {tuple(r) for r in patch_files.write_patches(df, str(tmp_path)).collect()} == {(p, 25) for p in range(5)}
    patch_files.register(spark)
    back = spark.read.format("patches").load(f"file://{tmp_path}")
    assert sorted(back.collect()) == sorted(df.collect())
    (tmp_path / "patch_9.bin").write_bytes(b"")
    assert back.where("pid <= 1").count() == 50
    from pyspark.sql.datasource import LessThanOrEqual

    reader = patch_files.PatchReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([LessThanOrEqual(("pid",), 1)])) == []
    assert sum(len(p.paths) for p in reader.partitions()) == 2


def test_text_tables(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("x,y,w\n1,2,3.5\r\n4 5 6\nbad\n7,8\n")
    assert [tuple(r) for r in text_tables.weighted_edges(spark, str(f)).collect()] == [(1, 2, 3.5), (4, 5, 6.0)]
    f.write_text("1,2,3,4,5,6\n")
    assert [tuple(r) for r in text_tables.extents(spark, str(f), 1).collect()] == [(0, 1, 2, 5, 6, 7)]
    f.write_text("ABS 1 0 5 1.5 2.5 0.1\nREL 1 0 5 2 1 2 3 4 5 6 1 0 3 0 1 4\nABS broken\n")
    a, r = text_tables.tagged_log(spark, str(f))
    assert a.count() == 1 and r.first()["other"] == 2.0


def test_chunk_store(spark, tmp_path):
    path = str(tmp_path / "store")
    text_tables.write_chunks(pp(spark), path, 8)
    one = spark.createDataFrame([(0, 0, 0)], "cx int, cy int, cz int")
    near = text_tables.read_chunks(spark, path, one)
    assert near.count() == near.where("cx between -1 and 1 and cy between -1 and 1 and cz between -1 and 1").count() > 0
    assert text_tables.read_chunks(spark, path).count() == 125


def test_stream_appends_what_is_new(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    df = pp(spark, 1)
    for k, part in enumerate((df.where("qx <= 0"), df)):
        part.coalesce(1).write.mode("append").parquet(str(src))
        q = appended.append_surface(spark.readStream.schema(df.schema).parquet(str(src)), store, str(tmp_path / "ck"))
        q.awaitTermination()
    assert spark.read.parquet(store).groupBy("qx", "qy").count().where("count > 1").count() == 0
    assert spark.read.parquet(store).count() == 25


def test_windowed_scores(spark):
    rows = [("2024-01-01 00:00:01", 1, 5), ("2024-01-01 00:04:00", 1, 9), ("2024-01-01 00:06:00", 1, 2)]
    df = spark.createDataFrame(rows, "ts string, file int, score int").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.best, r.n) for r in appended.windowed_scores(df).collect()) == [(2, 1), (9, 2)]
