"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``WINDOW`` consecutive words; a shorter item is
one window. A window is the set of its placed shingles (``SHINGLE`` words, or
all words of a shorter window). It occurs in a document only if all its shingles
do, so with shingles ordered from the rarest in the documents, its necessary
prefix is the first one. Documents are read twice:

1. occurrences of the benchmark's shingles are counted, in each task first; a
   window with a shingle that no document holds is done with;
2. places of prefix shingles come out with the words around them and are joined
   to the windows by shingle. The window's place of its shingle gives where it
   would start; bounds on place and length rule out windows that don't fit into
   the document, and the words themselves are compared.

Tasks know the shingles of interest by a bitmap of 2 ** ``BITS`` bits, whatever
the size of the benchmark. A wrongly set bit lets a row through that the join
drops. A passage that many documents hold is a hot key of the join's document
side alone, whose other side has a row for each window, so skewed partitions
can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.common import materialize, row_key, small_batches
from funnelspark.llm.textarrays import Spans, grams, hashes, runs, utf8

WINDOW = 10
SHINGLE = 3
BITS = 24
BITMAP = 1 << 15  # bits of one bitmap of Spark's bitmap functions

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(column: pa.Array) -> tuple[np.ndarray, Spans]:
    """Lower-cased bytes of the texts, and their words."""
    data, offsets = utf8(column)
    return _LOWER[data], runs(_WORD[data], offsets)


def _shingles(data: np.ndarray, spans: Spans, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, index of the first word, and size of every shingle of the given sizes."""
    word = hashes(data, spans)
    found = []
    for size in sizes:
        value, _ = grams(word, spans.row, size)
        n = max(len(word) - size + 1, 0)
        first = np.flatnonzero(spans.row[:n] == spans.row[size - 1 :]) if n else np.zeros(0, np.int64)
        found.append((value, first, np.full(len(value), size)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items -> their windows: item_id, the words joined by spaces, their number, and the shingles in order."""
    for batch in small_batches(batches, "text", 1 << 16):
        data, spans = _words(batch.column("text"))
        text = data.tobytes()
        counts = spans.counts()
        last = np.cumsum(counts)
        items = batch.column("item_id").to_pylist()
        for row, (n, end) in enumerate(zip(counts.tolist(), last.tolist())):
            if not n:
                continue
            at = range(end - n, end)
            words = [text[spans.start[i] : spans.end[i]].decode() for i in at]
            size = min(n, SHINGLE)
            own = Spans(spans.start[end - n : end], spans.end[end - n : end], np.zeros(n, np.int64), 1)
            shingle = grams(hashes(data, own), own.row, size)[0].view(np.int64)
            m = min(n, WINDOW)
            for lo in range(0, n - m + 1, 4096):  # a long item in several batches
                starts = range(lo, min(lo + 4096, n - m + 1))
                yield pa.RecordBatch.from_pydict({
                    "item_id": [items[row]] * len(starts),
                    "window": [" ".join(words[j : j + m]) for j in starts],
                    "m": pa.array([m] * len(starts), pa.int32()),
                    "shingles": pa.array([shingle[j : j + m - size + 1] for j in starts], pa.list_(pa.int64())),
                })


class Marked:
    """Finds shingles of a bitmap in batches of documents; the bitmap is a broadcast of fixed size."""

    def __init__(self, bitmap, sizes: list[int]):
        self.bitmap, self.sizes = bitmap, sizes

    def _found(self, data: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, first, size = _shingles(data, spans, self.sizes)
        bit = value >> np.uint64(64 - BITS)
        held = np.frombuffer(self.bitmap.value, dtype=np.uint8)
        keep = (held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return value[keep].view(np.int64), first[keep], size[keep]

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            value, n = np.unique(self._found(*_words(batch.column("text")))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["shingle", "n"])

    def places(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every document with its number of words and, for each shingle found, its place and the words around it."""
        kind = pa.struct([("place", pa.int64()), ("shingle", pa.int64()), ("lead", pa.int32()), ("around", pa.string())])
        for batch in small_batches(batches, "text", 4 << 20):
            data, spans = _words(batch.column("text"))
            text = data.tobytes()
            counts = spans.counts()
            first_word = np.cumsum(counts) - counts
            value, first, size = self._found(data, spans)
            order = np.argsort(first, kind="stable")
            value, first, size = value[order], first[order], size[order]
            row = spans.row[first]
            place = first - first_word[row]
            reach = np.where(size == SHINGLE, WINDOW - SHINGLE, 0)  # a smaller shingle is a whole window
            lead = np.minimum(place, reach)
            end = np.minimum(first + size + reach, (first_word + counts)[row])
            around = [b" ".join([text[a:b] for a, b in zip(spans.start[i:j].tolist(), spans.end[i:j].tolist())]).decode() for i, j in zip((first - lead).tolist(), end.tolist())]
            flat = pa.StructArray.from_arrays(
                [pa.array(place), pa.array(value), pa.array(lead.astype(np.int32)), pa.array(around, pa.string())], fields=list(kind))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                names=["doc_id", "key", "n_words", "places"])


def _marked(shingles: DataFrame, sizes: list[int]) -> Marked:
    """The bitmap of a column ``shingle``: at most 2 ** BITS / 8 bytes reach the driver, in pieces of 4 KB."""
    bit = F.shiftrightunsigned("shingle", 64 - BITS)
    pieces = shingles.groupBy(F.floor(bit / BITMAP).alias("piece")).agg(F.bitmap_construct_agg(bit % BITMAP).alias("bits")).collect()
    held = bytearray((1 << BITS) // 8)
    for piece, bits in pieces:
        held[piece * BITMAP // 8 : (piece + 1) * BITMAP // 8] = bits
    return Marked(shingles.sparkSession.sparkContext.broadcast(bytes(held)), sizes)


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, window, m, shingles), and the items of each (wid, item)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    cut = items.mapInArrow(_window_batches, "item_id string, window string, m int, shingles array<long>")
    cut = materialize(cut.withColumn("wid", F.xxhash64("window")), "benchmark_windows")
    return cut.select("wid", "window", "m", "shingles").dropDuplicates(["wid", "window"]), cut.select("wid", F.col("item_id").alias("item")).distinct()


def _prefixes(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """Each window with its rarest shingle and that one's place; windows with a shingle that no document holds are left out."""
    placed = windows.select("wid", "window", "m", F.posexplode("shingles").alias("q", "shingle")).join(rarity, "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "q"))
    return placed.groupBy("wid", "window", "m").agg(rarest.alias("p")).filter("p.n > 0").select("wid", "window", "m", "p.shingle", "p.q")


def _hit_words(spans: str):
    """Words covered by an array of (start, m): spans by start, each counted from where the ones before it end."""
    step = lambda held, s: F.struct(
        F.greatest(held["end"], s["start"] + s["m"]).alias("end"),
        (held["n"] + F.greatest(F.lit(0), s["start"] + s["m"] - F.greatest(held["end"], s["start"]))).alias("n"))
    zero = F.lit(0).cast("long")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("end"), zero.alias("n")), step, lambda held: held["n"])


def contaminated_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) of every row of ``docs`` (doc_id, text).

    Words are runs of ASCII letters and digits and of characters beyond ASCII,
    lower-cased in A-Z. Null and empty texts have no words and no hits; items
    without words have no window. Items that share an item_id are one item, an
    item without one has the empty id. Repeated documents, and documents without
    doc_id, are each looked at on their own. Other columns of both tables are
    ignored; with an empty benchmark nothing is hit.
    """
    texts = docs.select(F.col("doc_id").alias("doc_id"), row_key("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    windows, items = benchmark_windows(benchmark)
    sizes = sorted(r[0] for r in windows.select(F.least("m", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    wanted = windows.select(F.explode("shingles").alias("shingle"))
    counted = texts.select("text").mapInArrow(_marked(wanted, sizes).count, "shingle long, n long")
    rarity = counted.groupBy("shingle").agg(F.sum("n").alias("n"))
    prefixes = materialize(_prefixes(windows, rarity), "window_prefixes")

    id_type = texts.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {id_type}, key long, n_words long, places array<struct<place: long, shingle: long, lead: int, around: string>>"
    marked = materialize(texts.mapInArrow(_marked(prefixes, sizes).places, kind), "marked_documents")
    found = marked.select("doc_id", "key", "n_words", F.inline("places")).join(prefixes, "shingle")
    start, words = F.col("place") - F.col("q"), F.split("around", " ")
    found = found.filter((start >= 0) & (start + F.col("m") <= F.col("n_words")))
    same = F.array_join(F.slice(words, F.col("lead") - F.col("q") + 1, F.col("m")), " ") == F.col("window")
    hits = materialize(found.filter(same).select("doc_id", "key", start.alias("start"), "m", "wid").distinct(), "hits")
    covered = hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "m")).alias("spans"))
    covered = covered.select("doc_id", "key", _hit_words("spans").alias("n_hit"))
    named = hits.select("doc_id", "key", "wid").distinct().join(items, "wid").select("doc_id", "key", "item").distinct()
    named = named.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("item")).alias("items"))

    rows, none = marked.select("doc_id", "key", "n_words"), F.array().cast("array<string>")
    for part in (covered, named):
        part = part.withColumnsRenamed({"doc_id": "same_id", "key": "same_key"})
        rows = rows.join(part, F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("key") == F.col("same_key")), "left").drop("same_id", "same_key")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


#: DuckDB SQL for the query, over views ``documents`` and ``benchmark``.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {{words}} AS words FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {{words}} AS words FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(words), {WINDOW}) AS m, array_to_string(words[i : i + least(len(words), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
g AS (
  SELECT r, i, m, array_to_string(words[i : i + m - 1], ' ') AS g
  FROM (SELECT r, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM w))),
h AS (SELECT g.r, g.i, g.m, w.item FROM g JOIN w USING (m, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
""".format(words=r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
