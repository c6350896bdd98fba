import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zephyrine.llm import common


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8), max_size=4), st.integers(1, 80))
def test_chunks_keep_all_rows_and_stay_small(batches, limit):
    made = [pa.RecordBatch.from_arrays([pa.array(range(len(b)), pa.int64()), pa.array(b, pa.string())], names=["i", "t"]) for b in batches]
    got = list(common.chunks(iter(made), 1, limit))
    assert [t for c in got for t in c[1]] == [t or "" for b in batches for t in b]
    assert [i for c in got for i in c[0]] == [i for b in batches for i in range(len(b))]
    for ids, texts in got:
        assert ids and (len(texts) == 1 or sum(map(len, texts)) <= 2 * limit or max(map(len, texts)) > limit)


def test_batches_are_bounded_by_bytes(spark):
    common.ship(spark)
    df = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    got = [r.n for r in df.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 40_000_000 and max(got) < 2 * common.BATCH_BYTES


def test_crc(spark):
    df = spark.createDataFrame([(0,), (7,), (123456789012,), (None,)], "doc_id long")
    got = [tuple(r) for r in df.select("doc_id", common.crc_mod("doc_id", 5)).collect()]
    assert got == [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 5) for i, in df.collect()]


def test_cut_is_read_from_the_shared_folder(spark):
    df = common.cut(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_keep_rows_passes_columns_through(docs):
    got = common.keep_rows(docs, "text", lambda: lambda texts: [len(t) > 10 for t in texts], limit=50)
    assert got.schema == docs.schema
    assert got.count() == docs.where("length(coalesce(text, '')) > 10").count()
