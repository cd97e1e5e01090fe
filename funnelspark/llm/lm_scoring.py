"""Stupid-backoff scores of documents from bigram counts, computed relationally.

Words are lower-cased in A-Z and stand as 64-bit hashes, bigrams as hashes of
two of those. Both are counted in tables partitioned by hash:

    S(w | v) = c(v w) / c(v)        if v w was counted
             = ALPHA * c(w) / N     else, and for a first word without ALPHA

A document's score is the sum of the natural logs. Documents that are scored by
their own counts hold no unseen bigram, and a bigram seen once adds ln 1, so

    score = ln c(first) / N  -  sum of ln c(v) over words that another follows
            +  sum of ln c(v w) over bigrams seen twice or more

and neither join needs counts of words at bigrams. With another ``corpus`` as
the source of counts, unseen bigrams back off: the back-off term is summed over
all words, and a counted bigram adds the difference.

Every task adds up its own occurrences before the shuffle: counts for a batch of
texts, occurrences for each document. Tables hold a row for each n-gram, so a
partition of one is as large as the table over the number of partitions; joins
hash that side and don't sort the occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm.common import materialize, small_batches
from funnelspark.llm.textarrays import grams, hashes, utf8, words

ALPHA = 0.4
BATCH = 3 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _runs(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct rows of the columns, how often each occurs, and which of them each row is."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return [c[at] for c in columns], np.diff(np.append(at, len(order))), which


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hash, row, key of each row) of each batch of texts."""
    for batch in small_batches(batches, "text", BATCH):
        data, offsets = utf8(batch.column("text"))
        spans = words(data, offsets)
        if len(spans.row):
            yield hashes(data, spans, lower=True), spans.row, batch.column("key").to_numpy()


def _rows(columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a document: how often it stands there, how often first, and how often another word follows."""
    for word, row, key in _batches(batches):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        ends = np.append(starts[1:], len(row)) - 1
        (rows, held), n, which = _runs([row, word.view(np.int64)])
        first, last = (np.bincount(which[at], minlength=len(n)) for at in (starts, ends))
        yield _rows([held, key[rows], n.astype(np.int32), first.astype(np.int32), (n - last).astype(np.int32)], "a key times firsts followed")


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for word, row, _ in _batches(batches):
        gram, n = np.unique(grams(word, row, 2)[0].view(np.int64), return_counts=True)
        yield _rows([gram, n.astype(np.int32)], "gram n")


def _bigram_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different bigrams of a batch with both words."""
    for word, row, _ in _batches(batches):
        gram, at = grams(word, row, 2)[0].view(np.int64), np.flatnonzero(row[1:] == row[:-1])
        gram, first = np.unique(gram, return_index=True)
        yield _rows([gram, word[at[first]].view(np.int64), word[at[first] + 1].view(np.int64)], "gram a b")


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for word, row, key in _batches(batches):
        gram, at = grams(word, row, 2)
        (rows, held), n, _ = _runs([at, gram.view(np.int64)])
        yield _rows([held, key[rows], n.astype(np.int32)], "gram key times")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes the shuffle files of a table as soon as the table is written."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("key"), F.col("text").cast("string").alias("text"))


def _word_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("a").agg(F.sum("times").alias("c"))


def _bigram_table(texts: DataFrame, least: int) -> DataFrame:
    # a batch has each bigram once, so adding up again before the shuffle would find little to add
    counted = texts.mapInArrow(_bigram_counts, "gram long, n int").repartition("gram")
    return counted.groupBy("gram").agg(F.sum("n").alias("c2")).filter(F.col("c2") >= least)


def _gram_sums(texts: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of the weights (gram, v) over the bigrams of each document."""
    joined = texts.mapInArrow(_bigrams, "gram long, key long, times int").join(weights.hint("shuffle_hash"), "gram")
    return joined.groupBy("key").agg(F.sum(F.col("times") * F.col("v")).alias("g"))


def score(docs: DataFrame, corpus: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, log_score and per_word of every row of ``docs`` (doc_id, text).

    Counts cover all rows of ``docs``, or of ``corpus`` (text and doc_id, which
    may be null); there a word that the corpus lacks counts as seen once. Texts
    without words, null ones included, have 0 words, log_score 0 and per_word
    null. Rows that share a doc_id, or have none, are scored together and get
    their mean, so repeated rows get equal scores. Extra columns are ignored.
    """
    with _shuffles_removed(docs.sparkSession):
        base, gains = _own_sums(_texts(docs)) if corpus is None else _corpus_sums(_texts(docs), _texts(corpus), alpha)
    copies = docs.select("doc_id", _key().alias("key")).groupBy("key", "doc_id").agg(F.count("*").alias("copies"))
    sums = copies.join(base, "key", "left").join(gains, "key", "left")
    n = F.floor(F.coalesce("n", F.lit(0)) / F.col("copies"))
    log_score = F.when(n > 0, (F.col("s") + F.coalesce("g", F.lit(0.0))) / F.col("copies")).otherwise(0.0)
    out = sums.select("doc_id", n.cast("long").alias("n_words"), log_score.alias("log_score"), "copies")
    out = out.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "_copy")


def _word_sums(found: DataFrame, counts: DataFrame, how: str, weight: Callable) -> DataFrame:
    """(key, s, n): the weighted words of each document, and how many it has."""
    joined = found.join(counts.hint("shuffle_hash"), "a", how)
    return joined.groupBy("key").agg(F.sum(weight(F.coalesce("c", F.lit(1)))).alias("s"), F.sum("times").alias("n"))


def _own_sums(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = texts.mapInArrow(_words, "a long, key long, times int, firsts int, followed int")
    counts = materialize(_word_counts(found), "word_counts")
    total = F.lit(counts.agg(F.sum("c")).first()[0] or 1).cast("double")
    weight = lambda c: F.col("firsts") * F.log(c / total) - F.col("followed") * F.log(c)
    base = materialize(_word_sums(found, counts, "inner", weight), "word_sums")
    table = materialize(_bigram_table(texts, 2), "bigram_counts")
    return base, materialize(_gram_sums(texts, table.select("gram", F.log("c2").alias("v"))), "bigram_sums")


def _corpus_sums(texts: DataFrame, corpus: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    kind = "a long, key long, times int, firsts int, followed int"
    counts = materialize(_word_counts(corpus.mapInArrow(_words, kind)), "word_counts")
    total, back = F.lit(counts.agg(F.sum("c")).first()[0] or 1).cast("double"), F.log(F.lit(alpha))
    weight = lambda c: F.col("times") * F.log(c / total) + (F.col("times") - F.col("firsts")) * back
    base = materialize(_word_sums(texts.mapInArrow(_words, kind), counts, "left", weight), "word_sums")
    both = corpus.mapInArrow(_bigram_words, "gram long, a long, b long").dropDuplicates(["gram"])
    known = _bigram_table(corpus, 1).join(both, "gram")
    known = known.join(counts.select("a", F.col("c").alias("ca")), "a").join(counts.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b")
    gain = F.log(F.col("c2") / F.col("ca")) - F.log(F.col("cb") / total) - back
    table = materialize(known.select("gram", gain.alias("v")), "bigram_gains")
    return base, materialize(_gram_sums(texts, table), "bigram_sums")


#: DuckDB SQL for the scores, over a view ``documents``.
ORACLE = f"""
WITH w AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents)
), c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w),
t AS (SELECT sum(c)::DOUBLE AS n FROM c1),
p AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
s AS (
  SELECT p.doc_id, count(*) AS n_words,
    sum(CASE WHEN c2.c IS NOT NULL THEN ln(c2.c / cv.c::DOUBLE)
             WHEN p.v IS NULL THEN ln(cw.c / t.n) ELSE ln({ALPHA}) + ln(cw.c / t.n) END) AS log_score
  FROM p CROSS JOIN t JOIN c1 cw ON cw.w = p.w LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN c1 cv ON cv.w = p.v
  GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(log_score, 0), 4) AS log_score, round(log_score / n_words, 6) AS per_word
FROM documents d LEFT JOIN s USING (doc_id)
"""
