import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.cases import empty, frame, texts

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_minhash_near_dedup", "op6_embedding_near_dedup", "op9_suffix_dedup", "op11_divergence", "op12_substring_dedup", "op13_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET threads = 4")
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.project(", ".join(got.columns)).fetchall())


def test_one_query_for_each_operator():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.collect()} <= set(before)
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert whole.length.sum() == packed.length.sum() and set(whole.doc_id) == set(packed.doc_id)


def test_the_pipeline_leaves_other_results_alone(spark):
    """Lazy results that read kept tables are read after a run of the pipeline."""
    held = {name: __spark_entry__.queries()[name](spark, SF) for name in ("op2_minhash_near_dedup", "op6_embedding_near_dedup", "op7_pii_surrogates", "op9_suffix_dedup", "op11_divergence", "op12_substring_dedup", "op13_spelling_variants")}
    counts = {name: df.count() for name, df in held.items()}
    corpus_pipeline.run(spark, SF)
    assert {name: df.count() for name, df in held.items()} == counts


def test_pipeline_with_every_edge(spark, tmp_path):
    rows = texts() + [(2, "quite another text of the same id as before"), (None, None), (20, "12 34 56")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    kept, packed = {}, corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in packed:
        kept.setdefault(r.doc_id, []).append(r.length)
    assert {3, 4, 8, 10, 20} & set(kept) == set()  # no letters
    assert {1, 5, 7, 9, 11, 13, None} <= set(kept) and 6 not in kept  # of 5 and 6 the first stays
    assert len([n for n in kept[2] if n > 1]) == 1  # its other text is a copy of document 1
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_documents_stay_where_no_language_is_known(spark):
    docs = frame(spark, [(1, "some words"), (2, "12 34"), (3, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]
