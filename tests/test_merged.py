import os

from graphloom.sources.merged import MergedTable

SCHEMA = "k long, v string, n int"


def table(spark, path):
    return MergedTable(spark, str(path), spark.createDataFrame([], SCHEMA).schema, ("k",), "n")


def found(t):
    return {r["k"]: r["v"] for r in t.read().collect()}


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_batches_replace_rows_and_replays_change_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert found(t) == {}
    t.write(frame(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1)), "s", 0)
    t.write(frame(spark, (2, "d", 0), (None, "null", 0)), "s", 1)
    want = {1: "b", 2: "d", None: "null"}
    assert found(t) == want
    t.write(frame(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1)), "s", 0)  # comes again, stays older
    assert found(t) == want
    t.compact()
    assert found(t) == want
    t.write(frame(spark, (2, "c", 1)), "s", 0)  # the base has it
    t.compact()
    assert found(t) == want
    t.write(frame(spark, (2, "e", 0)), "other", 0)
    t.write(frame(spark, (3, "f", 0)))
    assert found(t) == want | {2: "e", 3: "f"}
    t.clean()
    assert found(t) == want | {2: "e", 3: "f"}
    t.write(frame(spark), "s", 2)
    t.compact()
    t.clean()
    assert found(t) == want | {2: "e", 3: "f"}
    assert sorted(x.split("-")[0] for x in os.listdir(tmp_path / "t") if not x.startswith(".")) == ["base", "done"]


def test_a_small_batch_writes_little_and_cut_off_writes_do_not_count(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.write(spark.range(200_000).selectExpr("id AS k", "sha2(string(id), 256) AS v", "0 AS n"), "s", 0)
    t.compact()
    t.clean()
    before = size(tmp_path)
    t.write(frame(spark, (7, "new", 1)), "s", 1)
    assert size(tmp_path) - before < before / 200
    assert t.read().where("k = 7").first()["v"] == "new" and t.read().count() == 200_000
    os.remove(tmp_path / "t" / next(x for x in os.listdir(tmp_path / "t") if x.startswith("delta")) / "_SUCCESS")
    assert t.read().where("k = 7").first()["v"] != "new" and t.read().count() == 200_000
    t.write(frame(spark, (7, "again", 1)), "s", 1)
    assert t.read().where("k = 7").first()["v"] == "again"


def test_stream_of_upserts(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for i in range(5):
        frame(spark, *((k, f"{i}", i) for k in range(i, 8))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    t.stream(rows(), str(tmp_path / "cp"), compact_every=2).trigger(availableNow=True).start().awaitTermination()
    want = {k: str(min(k, 4)) for k in range(8)}
    assert found(t) == want
    t.stream(rows(), str(tmp_path / "cp"), compact_every=2).trigger(availableNow=True).start().awaitTermination()
    assert found(t) == want
