"""Line dedup by content-defined chunks of lines.

Every line is hashed, and a rolling hash runs over each two lines. A chunk
starts where the rolling hash is less than both its neighbours, so boundaries
follow from a few lines around them and a passage is cut alike wherever it
stands. Chunks of two lines or more that occur again anywhere are compared byte
by byte with their first occurrence and removed. First means least in
(doc_id, text hash, place). Everything is a column expression.

``dedup_lines`` stops there, so it keeps what lies between the edge of a repeated
passage and its outermost boundaries. ``mark``, which the query and the pipeline
use, goes on with what the chunks leave: each two lines, and each line of over
LONG_WORDS words, unless it lies inside a removed chunk. So a repeated passage of
two lines or more goes whole, whatever its length and whatever stands around it.
A run inside a removed chunk needs no search of its own: it stands in the chunk's
first occurrence as well, which is kept and earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.common import let, materialize, nested, replace_text

MIN_LINES = 2
#: A line of more words is compared on its own.
LONG_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk_ranges(lines: Column) -> Column:
    """array<struct<first, last>>: the chunks of an array of lines, as places of lines."""

    def starts(rolled: Column) -> Column:
        n = F.size(rolled)
        least = lambda j: (F.get(rolled, j) < F.get(rolled, j - 1)) & (F.get(rolled, j) < F.get(rolled, j + 1))
        return F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | ((j >= MIN_LINES) & (j <= n - MIN_LINES) & least(j)))

    rolled = let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))))
    return let(F.struct(let(rolled, starts).alias("s"), F.size(lines).alias("n")), lambda v: F.transform(
        v["s"], lambda s, i: F.struct(s.alias("first"), (F.coalesce(F.get(v["s"], i + 1), v["n"]) - 1).alias("last"))))


def _has_text(text: Column) -> Column:
    return text.rlike(r"[^ \n\t\r]")


def _run_text(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def _pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, last, chunk_hash, inner, edge): every chunk with its runs.

    A chunk of one line or without text has no hash. ``inner`` are the runs inside the
    chunk, ``edge`` is the one across its end: every two lines with some text, and
    every long line, as (first, last, run_hash).
    """
    hashed = lambda text, lines: F.xxhash64(text, F.length(text), lines)

    def chunks(v: Column) -> Column:
        lines = v["lines"]

        def twos(from_: Column, n: Column) -> Column:
            """The runs of two lines that start at ``n`` places on from a place."""
            run = lambda i: F.struct(i.alias("first"), (i + 1).alias("last"), _run_text(lines, i, i + 1).alias("run"))
            places = F.transform(F.slice(F.sequence(from_, from_ + n), 1, n), lambda i: run(i))
            return F.transform(F.filter(places, lambda r: _has_text(r["run"])), lambda r: F.struct(r["first"], r["last"], hashed(r["run"], F.lit(1)).alias("run_hash")))

        def longs(c: Column) -> Column:
            long_ = F.filter(F.sequence(c["first"], c["last"]), lambda i: F.get(lines, i).rlike(rf"^\s*+(?:\S++\s++){{{LONG_WORDS}}}\S"))
            return F.transform(long_, lambda i: F.struct(i.alias("first"), i.alias("last"), hashed(F.get(lines, i), F.lit(0)).alias("run_hash")))

        def chunk(c: Column) -> Column:
            whole = let(_run_text(lines, c["first"], c["last"]), lambda t: F.when(_has_text(t), hashed(t, c["last"] - c["first"])))
            return F.struct(
                c["first"].alias("first"), c["last"].alias("last"), F.when(c["last"] - c["first"] + 1 >= MIN_LINES, whole).alias("chunk_hash"),
                F.concat(twos(c["first"], c["last"] - c["first"]), longs(c)).alias("inner"),
                twos(c["last"], F.when(c["last"] < F.size(lines) - 1, 1).otherwise(0)).alias("edge"))

        return F.transform(v["ranges"], chunk)

    some = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), _lines(F.col("text")).alias("lines"))
    cut = let(F.struct(F.col("lines").alias("lines"), chunk_ranges(F.col("lines")).alias("ranges")), chunks)
    return some.select("doc_id", "text_hash", F.explode(cut).alias("c")).select("doc_id", "text_hash", "c.*")


def _chunks_of(pieces: DataFrame) -> DataFrame:
    return pieces.filter(F.col("chunk_hash").isNotNull()).select("doc_id", "text_hash", "first", "last", F.col("chunk_hash").alias("run_hash"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, last): every chunk of lines that equals an earlier one."""
    return _repeated(docs, _chunks_of(materialize(_pieces(docs), "chunks")))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, last): the repeated chunks, and every run outside of them that equals an earlier one."""
    pieces = materialize(_pieces(docs), "chunks_and_runs")
    whole = materialize(_repeated(docs, _chunks_of(pieces)), "repeated_chunks")
    gone = whole.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("first").alias("_first"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("first") == F.col("_first"))
    left = pieces.select("doc_id", "text_hash", "first", "inner", "edge").join(gone.hint("merge"), same, "left")
    runs = F.when(F.col("_hash").isNull(), F.concat("inner", "edge")).otherwise(F.col("edge"))
    rest = materialize(left.select("doc_id", "text_hash", F.explode(runs).alias("r")).select("doc_id", "text_hash", "r.*"), "runs")
    return whole.unionByName(_repeated(docs, rest))


def _repeated(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, last): those of ``runs`` (with run_hash) that equal an earlier one.

    Hashes find the runs; texts are read for runs of repeated hashes alone. Two
    equal lines after the first of their kind don't count where they overlap it.
    """
    place = F.struct("doc_id", "text_hash", "first")
    before = F.struct("doc_id", "text_hash", (F.col("first") - (F.col("last") - F.col("first"))).alias("first"))
    counted = materialize(runs.groupBy("run_hash").agg(F.count("*").alias("n"), F.min(place).alias("least")).filter("n > 1").drop("n"), "repeated_hashes")
    found = runs.join(counted.hint("merge"), "run_hash").withColumn("is_first", place.eqNullSafe(F.col("least")) | before.eqNullSafe(F.col("least")))
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("first", "last", "run_hash", "is_first")).alias("found"))
    found = materialize(found, "runs_of_documents")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(
        found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    cut = let(F.struct(F.col("found").alias("found"), _lines(F.col("text")).alias("lines")), lambda v: F.transform(v["found"], lambda r: F.struct(
        r["first"].alias("first"), r["last"].alias("last"), r["run_hash"].alias("run_hash"), r["is_first"].alias("is_first"),
        _run_text(v["lines"], r["first"], r["last"]).alias("run"))))
    members = materialize(texts.select("doc_id", "text_hash", F.explode(cut).alias("r")).select("doc_id", "text_hash", "r.*"), "repeated_runs")
    firsts = members.filter("is_first").select("run_hash", F.col("run").alias("first_run")).dropDuplicates(["run_hash"])
    same = members.filter("NOT is_first").join(firsts.hint("merge"), "run_hash").filter(F.col("run") == F.col("first_run"))
    return same.select("doc_id", "text_hash", "first", "last").distinct()


def _united(ranges: Column) -> Column:
    """Ranges whose starts and ends both rise, with those that overlap or touch made one."""

    def starts(v: Column) -> Column:
        fresh = lambda i: (i == 0) | (F.get(v, i)["first"] > F.get(v, i - 1)["last"] + 1)
        return F.struct(v.alias("r"), F.filter(F.sequence(F.lit(0), F.size(v) - 1), fresh).alias("s"))

    return let(let(ranges, starts), lambda v: F.transform(v["s"], lambda s, i: F.struct(
        F.get(v["r"], s)["first"].alias("first"), F.get(v["r"], F.coalesce(F.get(v["s"], i + 1), F.size(v["r"])) - 1)["last"].alias("last"))))


def _marked(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    gone = repeated.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("removed_ranges"))
    gone = materialize(gone.withColumn("removed_ranges", _united(F.col("removed_ranges"))), "removed_ranges")
    return docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left").drop("_id", "_hash")


def mark(docs: DataFrame) -> DataFrame:
    """``docs`` with ``removed_ranges``: the ranges of lines (first, last, from 0) to remove, apart and in order; null if none.

    Null and blank texts have none. Rows without doc_id come first; rows equal in
    doc_id and text are one document and get the same ranges.
    """
    return _marked(docs, repeated_runs(docs))


def without_ranges(text: Column, ranges: Column) -> Column:
    """The text without the given ranges of lines."""

    def rest(v: Column) -> Column:
        # kept lines lie between the end of one range and the start of the next
        edges = F.concat(F.array(F.lit(-1)), F.transform(v["r"], lambda x: x["last"]))
        starts = F.concat(F.transform(v["r"], lambda x: x["first"]), F.array(F.size(v["l"])))
        return F.flatten(F.zip_with(edges, starts, lambda a, b: F.slice(v["l"], a + 2, b - a - 1)))

    return F.when(ranges.isNull(), text).otherwise(F.array_join(let(F.struct(ranges.alias("r"), _lines(text).alias("l")), rest), "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated chunks of lines alone; n_chars, where there is one, follows the text.

    Other columns and the number of rows stay; a text may end up empty. Null and
    empty texts and texts of one line stay as they are. Rows equal in doc_id and
    text are one document: they keep the same lines. Rows without doc_id come first.
    """
    return nested(docs, lambda own: _without_marked(_marked(own, repeated_chunks(own))))


def _without_marked(marked: DataFrame) -> DataFrame:
    text = without_ranges(F.col("text"), F.col("removed_ranges"))
    return replace_text(marked, text, F.col("removed_ranges").isNotNull())


def drop_emptied(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated runs of lines, and without the rows that lost all of their text; columns as in ``dedup_lines``.

    Null, empty and blank texts lose nothing and stay, as does the first
    occurrence of a run: that of the least doc_id, rows without doc_id first.
    Rows equal in doc_id and text are one document and keep the same lines.
    """
    def rest(own: DataFrame) -> DataFrame:
        return _without_marked(mark(own)).filter(F.col("removed_ranges").isNull() | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))

    return nested(docs, rest)
