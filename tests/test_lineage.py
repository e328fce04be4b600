"""Tables in the shared folder, numbering, and small sides of joins."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.plans import lineage


def test_numbers_are_consecutive_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    out, count = lineage.numbered(df, F.col("k").desc(), "i", after=10, name="n")
    assert count == 300 and out.columns == ["k", "i", "n"]
    assert [(r.k, r.i, r.n) for r in out.orderBy("n").collect()] == [(*r, n) for n, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 11)]
    empty, none = lineage.numbered(df.limit(0), "i")
    assert none == 0 and empty.count() == 0


def test_small_sides_are_checked(spark, monkeypatch):
    df = lineage.cut(spark.range(1000), "small")
    sent = lambda x: "BroadcastHashJoin" in spark.range(5000).join(x, "id")._jdf.queryExecution().executedPlan().toString()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sent(lineage.beside(df)) and not sent(lineage.beside(df, 999))
        monkeypatch.setattr(lineage, "MOST_BYTES", 10)
        assert not sent(lineage.beside(df))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.sql.warehouse.dir": "/warehouse"}.get(key, default))

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        lineage.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert lineage.shared_dir(Session).startswith("/warehouse/")


def test_release_deletes_what_the_session_wrote(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lineage, "shared_dir", lambda _: str(tmp_path))
    df = lineage.cut(spark.range(3))
    assert df.count() == 3 and len(list(tmp_path.iterdir())) == 1
    lineage.release(spark)
    assert not list(tmp_path.iterdir())
