"""What the operators share."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import common


def test_workers_get_small_batches_and_every_row(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    before = spark.conf.get(common.BATCH_KEY)
    texts = spark.range(0, 6000, 1, 1).select(F.expr("repeat('x', if(id = 5999, 6000000, 2000))").alias("text"))  # 18 MB, the last row alone more than a batch
    got = common.written(common.written(texts, "texts").coalesce(1).mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r.rows for r in got) == 6000
    assert all(r.bytes <= common.BATCH + 6_100_000 for r in got) and max(r.rows for r in got) < 3000
    assert sum(r.bytes for r in got) > 17_000_000
    assert spark.conf.get(common.BATCH_KEY) == before


def test_the_session_gets_its_limit_back(spark):
    before = spark.conf.get(common.BATCH_KEY)
    with pytest.raises(Exception, match="division|DIVIDE"):
        common.written(spark.range(1).select(F.raise_error(F.lit("division"))), "fails")
    assert spark.conf.get(common.BATCH_KEY) == before
    try:
        spark.conf.set(common.BATCH_KEY, "1m")  # a smaller one stays
        with common.small_batches(spark):
            assert spark.conf.get(common.BATCH_KEY) == "1m"
    finally:
        spark.conf.set(common.BATCH_KEY, before)
