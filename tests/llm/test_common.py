import pytest
from pyspark.sql import functions as F

from millrace.llm import common as C


def components(edges):
    comp = {x: x for e in edges for x in e}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        comp[b] = a
    return sorted((x, root(x)) for x in comp)


@pytest.mark.parametrize("kind", ["star from below", "star from above", "path", "mixed"])
def test_components(spark, kind):
    n = 400
    edges = {
        "star from below": [(0, i) for i in range(1, n)],
        "star from above": [(n, i) for i in range(n)],
        "path": [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(60)],
        "mixed": [(0, i) for i in range(1, n, 3)] + [(i, i + 1) for i in range(1, n, 5)] + [(2, 2), (900, 901), (901, 900)],
    }[kind]
    got = C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(tuple(r) for r in got) == components([e for e in edges if e[0] != e[1]])


def test_hot_keys_are_split(spark):
    """A key with a third of the rows meets no exchange; every other key has under one row in HOT_KEYS."""
    n = 30_000
    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") == 1, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x")).repartition(8).cache()
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("least")).where("k <> 5").cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how, missing in (("inner", 0), ("left", 2)):
            got = C.beside(left, right, ["k"], how)
            assert sorted(got.groupBy("k").count().where("count > 1").collect()) == [(-1, n // 3)]
            assert got.count() == n - 2 + missing and got.where("k = -1 and least <> 0").count() == 0
            # The rows of the hot key stay in the tasks they were in, whatever the join's exchange is.
            tasks = got.where("k = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
            assert len(tasks) >= 8 and max(r["count"] for r in tasks) < n // 3 // 4
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    none = C.beside(left, right.where("false"), ["k"], "left")
    assert none.count() == n and none.where("least is not null").count() == 0


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "shared_folder", lambda _: f"file://{tmp_path}")
    with C.scratch(spark):
        assert C.stage(spark.range(5), "five").count() == 5 and list((tmp_path / "millrace").glob("five*"))
    assert not list((tmp_path / "millrace").glob("five*"))


def test_scratch_leaves_other_threads_tables(spark):
    """A block that ends while another thread has staged a table takes only its own along."""
    from threading import Event, Thread

    staged, ended, counts = Event(), Event(), []

    def other() -> None:
        with C.scratch(spark):
            df = C.stage(spark.range(7), "other")
            staged.set()
            ended.wait(60)
            counts.append(df.count())

    thread = Thread(target=other)
    with C.scratch(spark):
        thread.start()
        assert staged.wait(60)
        C.stage(spark.range(3), "own")
    ended.set()
    thread.join()
    assert counts == [7]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        C.shared_folder(Session)
    Context.getCheckpointDir = staticmethod(lambda: "hdfs://x/y")
    assert C.shared_folder(Session) == "hdfs://x/y"


def test_row_lists_beyond_the_bound_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 5 else "t", i) for i in range(50)], "doc_id long, text string, rid long").repartition(3).cache()
    gone = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id").where("doc_id % 2 = 0").select("rid")
    for few in (C.FEW, 3):
        monkeypatch.setattr(C, "FEW", few)
        left = C.without(docs, gone)
        assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == list(range(1, 50, 2))
