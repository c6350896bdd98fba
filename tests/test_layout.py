from pyspark.sql import functions as F

from zephyrine.sources import files, layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_has_no_shuffle(spark, sf):
    a = layout.bucketed(files.load(spark, sf, "orders"), "zephyrine_orders", ["o_orderkey"], 4)
    b = layout.bucketed(files.load(spark, sf, "lineitem"), "zephyrine_lines", ["l_orderkey"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, a.o_orderkey == b.l_orderkey)
        assert "Exchange" not in plan(joined)
        assert joined.count() == files.load(spark, sf, "lineitem").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 4" in plan(a.where("o_orderkey = 7"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_clustered(spark, sf, tmp_path):
    df = layout.clustered(files.load(spark, sf, "orders"), f"{tmp_path}/o", ["o_orderkey"], 5)
    spans = df.groupBy(F.input_file_name().alias("f")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).orderBy("a").collect()
    assert len(spans) == 5 and all(x.b < y.a for x, y in zip(spans, spans[1:]))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in plan(df.where("o_orderkey > 10"))


def test_slots(spark):
    got = layout.hash_slots(spark.range(1000), ["id"], 16)
    assert {r.slot for r in got.select("slot").distinct().collect()} == set(range(16))


def test_scans_read_what_is_asked(spark, sf):
    said = plan(files.load(spark, sf, "lineitem").where("l_quantity > 30").select("l_orderkey"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in said and "GreaterThan(l_quantity,30.0)" in said


def test_files(spark, tmp_path):
    df = files.values(spark, "a int, b string", (1, "x"), (2, None))
    df.write.json(f"{tmp_path}/j")
    df.write.option("header", True).csv(f"{tmp_path}/c")
    assert sorted(map(tuple, files.json_rows(spark, f"{tmp_path}/j", df.schema).collect())) == [(1, "x"), (2, None)]
    assert sorted(map(tuple, files.csv_rows(spark, f"{tmp_path}/c", df.schema).collect())) == [(1, "x"), (2, None)]
    assert files.generate(spark, 3).count() == 3
