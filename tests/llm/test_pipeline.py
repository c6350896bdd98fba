import corpus_pipeline
from test_nearcopies import plain
from zephyrine.llm import mixing, quality, queries, rules


def test_run(spark, sf):
    """Every stage against the operator's own result, or all pairs, on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = {r.doc_id for r in rules.judge(docs, rules.fit(docs, labels)).where("kept").collect()}
    model = quality.fit(docs, labels)
    kept = docs.where(docs.doc_id.isin(*ids))
    ids = {r.doc_id for r in quality.score(kept, model).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in ids)
    least = {}
    for (i, _, _), c in zip(rows, plain(rows)):
        least.setdefault(c, i)
    ids = sorted(least.values())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == ids
    want = {r.doc_id: tuple(r) for r in queries.op3_byte_bpe(spark, sf).collect()}
    assert all(tuple(r)[:4] == want[r.doc_id] for r in got)
    # the order is that of the mixture
    placed = mixing.schedule(docs.where(docs.doc_id.isin(*ids)), ties=("text",)).collect()
    assert {r.doc_id: r.position for r in got} == {r.doc_id: r.position for r in placed}


def write(docs, labels, path):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows(spark, docs, labels, tmp_path):
    """Nulls, repeated rows and ids, very long texts, and columns with names that clash with working ones."""
    path = write(docs, labels, tmp_path)
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, path)
        assert own.columns == docs.columns
        own.write.parquet(f"{path}/{name}")
        own = spark.read.parquet(f"{path}/{name}")
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.position for r in got) == list(range(own.count()))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in own.collect())


def test_odd_rows_in_each_stage(spark, docs, labels, tmp_path):
    """Each stage by itself on all odd rows."""
    path = write(docs, labels, tmp_path)
    n = docs.count()
    made = {name: stage(spark, docs, path) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(d.columns == docs.columns for d in made.values())
    assert made["source_mixing"].count() == n
    assert 0 < made["near_dedup"].count() < n
    read = spark.read.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.byte_bpe(spark, read, path).count() == n


def test_empty_table(spark, empty, labels, tmp_path):
    path = write(empty, labels, tmp_path)
    assert corpus_pipeline.run(spark, path).count() == 0


def test_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{i}" for i in range(1, 11)}
