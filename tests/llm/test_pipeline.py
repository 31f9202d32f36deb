"""Every stage of the corpus pipeline against a plain version, on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleettrack.llm import decontamination, ngram_join, toxicity
from fleettrack.llm.common import made_since, mark, same_order, stored

from tests.llm.test_joins import plain_components
from tests.llm.test_texts import least_edits, plain_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test-stage"))
    return out


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_and_columns(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for t in tables[1:-1]:
        assert t.columns == tables[0].columns and t.dtypes == tables[0].dtypes


def test_toxicity_stage(spark, tables):
    scores = toxicity.score(tables[0], toxicity.train(tables[0], spark.read.parquet(f"{SF}/labels.parquet")))
    assert sorted(r["doc_id"] for r in tables[1].collect()) == sorted(r["doc_id"] for r in scores.where("p_toxic < 0.5").collect())


def test_line_stage(tables):
    want = [(d, t) for d, _, _, _, t in plain_dedup(rows(tables[1]))]
    assert sorted(((d, t) for d, t, _ in rows(tables[2])), key=str) == sorted(want, key=str)
    assert tables[2].where("n_chars <> length(text)").count() == 0


def test_near_duplicate_stage(tables):
    want = {d for d, (_, c) in plain_components([(d, t) for d, t, _ in rows(tables[2])]).items() if d == c}
    assert {d for d, _, _ in rows(tables[3])} == want


def test_leak_stage(spark, tables):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {d for d, _, _ in rows(tables[4])}
    plain = {d for d, t, _ in rows(tables[3]) if any(decontamination.normal(i) in decontamination.normal(t or "") for _, i in items)}
    index = decontamination.Index(items, 8, 0.1, 50)
    near = {d for d, t, _ in rows(tables[3]) if any(least_edits(decontamination.normal(i), decontamination.normal(t or "")) <= index.edits[index.ids.index(k)] for k, i in items if k in index.ids and shares_grams(index, k, i, t or ""))}
    assert not kept & plain and kept == {d for d, _, _ in rows(tables[3])} - plain - near


def shares_grams(index, item, text, doc):
    """Whether a document has as many of the item's q-grams as any place within its edits has: others need no alignment."""
    pattern, whole = decontamination.normal(text), decontamination.normal(doc)
    return sum(pattern[k : k + 8] in whole for k in range(len(pattern) - 7)) >= index.bound[index.ids.index(item)]


def test_a_stage_leaves_what_others_still_read(spark):
    """Results that are not yet computed stay readable while further stages run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    second = corpus_pipeline.STAGES[2][1](spark, first, SF)
    third = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    assert first.count() == docs.count() >= second.count() > 0 and third.count() <= docs.count()


def test_jaccard_stage_on_a_table_whose_partitions_are_partly_empty(spark, tables):
    """A stage reads a table with partitions without rows as it reads any other."""
    docs = tables[2].coalesce(1).unionByName(tables[2].where("doc_id < 0")).unionByName(tables[2].where("doc_id is null"))
    got = corpus_pipeline.STAGES[2][1](spark, docs, SF).select("doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, tables[3].select("doc_id").collect()))


def test_jaccard_stage_on_files_larger_than_a_task_reads(spark, tables, tmp_path):
    """Stage 2 writes few large files, which stage 3 reads in pieces: no row group begins in most of them."""
    tables[2].coalesce(1).write.parquet(str(tmp_path / "stage-2"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        docs = spark.read.parquet(str(tmp_path / "stage-2"))
        assert 0 in docs.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        got = corpus_pipeline.STAGES[2][1](spark, docs, SF).select("doc_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted(map(tuple, tables[3].select("doc_id").collect()))


def test_jaccard_stage_on_rows_that_come_in_another_order_each_time(spark, tables, monkeypatch):
    """The result of a stage that is not stored is made anew by each reading, and a shuffle deals it out as it arrives; blocks have to be the same all the same."""
    monkeypatch.setattr(ngram_join.shared_sets, "__defaults__", (2000,))  # several blocks to a partition

    def dealt(frames):
        for pdf in frames:
            yield pdf.sample(frac=1, random_state=random.SystemRandom().randrange(1 << 30))

    far = tables[2].withColumns({"doc_id": F.explode(F.expr("transform(sequence(0, 4), k -> k * 1000000L + doc_id)"))})
    rows = stored(far.select(tables[2].columns).coalesce(1), "test-rows")
    want = corpus_pipeline.STAGES[2][1](spark, rows, SF).select("doc_id").collect()
    number = mark()
    got = corpus_pipeline.STAGES[2][1](spark, rows.coalesce(1).mapInPandas(dealt, rows.schema), SF).select("doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and rows.count() == 5 * tables[2].count()
    assert not [p for p in made_since(number) if "shingle-rows" in p]


def test_which_rows_are_read_in_the_same_order(spark, tables):
    docs = tables[0]
    assert all(map(same_order, (docs, tables[2], docs.where("doc_id > 3").select("text"), docs.unionByName(docs))))
    assert not any(map(same_order, (docs.distinct(), docs.repartition(3), docs.withColumn("r", F.rand()), docs.join(docs.select("doc_id"), "doc_id"), spark.createDataFrame(docs.rdd, docs.schema))))


def test_packing_stage(tables):
    pieces = tables[5].toPandas()
    assert set(pieces["doc_id"]) == {d for d, _, _ in rows(tables[4])}
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run_is_the_stages(spark, tables):
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").sum("length").collect()
    want = tables[5].groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
