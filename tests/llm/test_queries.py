"""The registered queries, their oracles and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from funnelspark.llm import queries
from tests.llm.conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    result = connection.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(repr([r[c] for c in sorted(columns)]) for r in df.collect()) == sorted(repr([r[i] for i in order]) for r in result.fetchall())


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages_keep_columns_and_run_gives_their_result(spark, documents, odd_docs):
    docs = documents.unionByName(odd_docs)
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == documents.columns
        docs = spark.createDataFrame(docs.collect(), documents.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    pieces = corpus_pipeline.run(spark, SMALL)
    assert pieces.count() > 0 and pieces.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


CLASHING = (
    "removed_ranges", "_id", "_hash", "_changed", "lang_pred", "score", "_letter", "secrets", "_n", "_text", "bits_per_byte", "whole_text", "text_hash", "row_id",
    "rep", "first", "component", "other_columns", "a.b", "key",
)


def test_stages_pass_on_columns_of_any_name(spark, documents, odd_docs):
    docs = documents.limit(40).unionByName(odd_docs)
    extra = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    extra = spark.createDataFrame(extra.collect(), extra.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SMALL)
        assert out.columns == extra.columns, name
        wrong = [c for r in out.filter("doc_id IS NOT NULL").collect() for c in CLASHING if r[c] != f"{c}{r.doc_id}"]
        assert not wrong, (name, wrong[:3])


def test_without_labels_every_document_stays(spark, documents):
    bare = documents.limit(30).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, bare, SMALL).count() == 30


def test_texts_in_no_learned_language_go(spark, documents, make_docs):
    strange = make_docs((10**6, "日本語のテキストです。これは学習していない言語。" * 5, None), (10**6 + 1, "q8Zk2Lx9VbT4mWc7Rj1NpYs3Hd6Fg5Aa" * 8, None))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, documents.unionByName(strange), SMALL).collect()}
    lettered = {r.doc_id for r in documents.filter(F.col("text").rlike(r"\p{L}")).collect()}
    assert kept == lettered
