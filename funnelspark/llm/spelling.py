"""Spelling variants at one edit, found by pivotal bigrams.

Bigrams of all words are ordered from the rarest. A word's prefix is its first
``Q * TAU + 1`` placed bigrams, and all further ones equal to the last of them.
Of the prefix, dynamic programming picks ``TAU + 1`` disjoint bigrams of least
total frequency, the pivots. One edit spoils one of two disjoint bigrams, so if
two words are near and the prefix of r doesn't end later in the order than that
of s, a pivot of r stands in the prefix of s. Position limits: a spared bigram
keeps its place if the edit comes after it, and its distance from the end if the
edit comes before it. In both cases everything on its far side is spared too, so
the index key is that stretch of letters from the word's start or end, with the
other word's length. Candidates whose sets of bigrams, as signatures of 64 bits,
differ in more bits than one edit can change are dropped; the rest is verified
exactly.

The table of bigrams is bounded by the alphabet: 90 letters, 8,100 rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.common import crc32_sql, materialize, small_batches
from funnelspark.llm.textarrays import Spans, hashes, mix, runs, utf8

TAU = 1
Q = 2
MIN_LENGTH = 5
MIN_COUNT = 3
EDITED = 97

_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8
_LETTERS = 90  # a to z, then U+00C0 to U+00FF
_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], dtype=np.uint32)


def _crc32(head: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """zlib.crc32 of spans of bytes, each going on from a checksum ``head``; all spans a byte at a time."""
    order = np.argsort(-length, kind="stable")
    state = (head[order] ^ np.uint32(0xFFFFFFFF)).astype(np.uint32)
    start, length = start[order], length[order]
    live = len(order)
    for j in range(int(length[0]) if live else 0):
        live = int(np.searchsorted(-length[:live], -j, side="left"))  # those longer than j
        x = state[:live]
        state[:live] = _CRC[(x ^ data[start[:live] + j]) & np.uint32(0xFF)] ^ (x >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _without(word: str, place: int) -> str:
    return word[:place] + word[place + 1 :]


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each batch of documents: runs of letters lower-cased in A-Z, some of them with a letter taken out."""
    for batch in small_batches(batches, "text", 4 << 20):
        data, offsets = utf8(batch.column("text"))
        lead = data == _LEAD
        inside = _ASCII[data] | lead
        inside[1:] |= lead[:-1]
        spans = runs(inside, offsets)
        leads = np.concatenate([[0], np.cumsum(lead)])
        size = spans.end - spans.start
        letters = size - (leads[spans.end] - leads[spans.start])
        keep = letters >= MIN_LENGTH  # a shorter run can't become long enough
        flags = np.zeros(len(data) + 1, np.int8)
        flags[spans.start[keep]] += 1
        np.add.at(flags, spans.end[keep], -1)
        ends = np.concatenate([[0], np.cumsum(size[keep])])
        kept = _LOWER[data[np.cumsum(flags[:-1]) > 0]]
        words = pa.LargeStringArray.from_buffers(int(keep.sum()), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)).dictionary_encode()
        texts = words.dictionary
        if not len(texts):
            continue
        pair, n = np.unique(spans.row[keep] * len(texts) + words.indices.to_numpy().astype(np.int64), return_counts=True)
        row, code = pair // len(texts), pair % len(texts)
        heads = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in batch.column("doc_id").to_pylist()], dtype=np.uint32)
        held, at = utf8(texts)
        check = _crc32(heads[row], held, at[code], np.diff(at)[code])
        edited = check % EDITED == 0
        whole = np.bincount(code[~edited], weights=n[~edited], minlength=len(texts)).astype(np.int64)
        seen = np.flatnonzero(whole)
        out, count = texts.take(pa.array(seen)).to_pylist(), whole[seen].tolist()
        for c, h, k in zip(code[edited].tolist(), check[edited].tolist(), n[edited].tolist()):
            word = texts[c].as_py()
            if len(word) > MIN_LENGTH:
                out.append(_without(word, h % len(word)))
                count.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(count, pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words of all texts; every task adds up a batch of texts before the shuffle."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_word_batches, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bigram, row and place of every bigram; byte where each letter starts (with an end), and the first letter of each row."""
    data, offsets = utf8(column)
    first = (data & 0xC0) != 0x80
    start = np.flatnonzero(first)
    two = data[start] == _LEAD
    letter = data[start].astype(np.int64) - 97
    letter[two] = data[start[two] + 1].astype(np.int64) - 0x80 + 26
    row = np.searchsorted(offsets, start, side="right") - 1
    counts = np.bincount(row, minlength=len(column))
    own = np.cumsum(counts) - counts
    at = np.flatnonzero(row[1:] == row[:-1])
    return letter[at] * _LETTERS + letter[at + 1], row[at], at - own[row[at]], np.append(start, len(data)), own


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram, n = np.unique(_bigrams(batch.column("word"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])


def pivots(place: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Bits of the TAU + 1 disjoint bigrams of least total cost, for rows of bigrams in order of place.

    best[k][i] is the least cost of k bigrams among the first i, and chosen the
    bits of those; a bigram follows only those that end before it. Ties go to
    the bigrams that stand further left.
    """
    rows, width = place.shape
    best = np.full((TAU + 2, width + 1, rows), np.iinfo(np.int64).max // 4)
    chosen = np.zeros((TAU + 2, width + 1, rows), dtype=np.int64)
    best[0] = 0
    each = np.arange(rows)
    for i in range(width):
        before = (place[:, :i] <= place[:, i : i + 1] - Q).sum(axis=1)  # so many of the first i end before bigram i
        for k in range(1, TAU + 2):
            with_it = best[k - 1, before, each] + cost[:, i]
            better = with_it < best[k, i]
            best[k, i + 1] = np.where(better, with_it, best[k, i])
            chosen[k, i + 1] = np.where(better, chosen[k - 1, before, each] | (1 << i), chosen[k, i])
    return chosen[TAU + 1, width]


class Index:
    """Index and probe rows of words; ``often`` holds the frequency of each bigram."""

    def __init__(self, often: np.ndarray):
        self.often = often
        self.rank = np.empty(len(often), dtype=np.int64)
        self.rank[np.lexsort([np.arange(len(often)), often])] = np.arange(len(often))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = Q * TAU + 1
        for batch in small_batches(batches, "word"):
            gram, row, place, start, own = _bigrams(batch.column("word"))
            data, offsets = utf8(batch.column("word"))
            length = np.bincount(row, minlength=batch.num_rows) + 1
            rank = self.rank[gram]
            order = np.lexsort([place, rank, row])
            gram, row, place, rank = gram[order], row[order], place[order], rank[order]
            first = np.cumsum(length - 1) - (length - 1)
            signature = np.bitwise_or.reduceat(np.uint64(1) << (mix(gram.astype(np.uint64)) >> np.uint64(58)), first).view(np.int64)
            head = first[:, None] + np.arange(width)
            last = rank[head[:, -1]]
            prefix = np.flatnonzero(rank <= last[row])
            by_place = np.take_along_axis(head, np.argsort(place[head], axis=1), axis=1)
            bits = pivots(place[by_place], self.often[gram[by_place]])
            pivot = np.sort(by_place[(bits[:, None] >> np.arange(width)) & 1 == 1])
            keys, rows, probes = [], [], []
            for at, changes in ((prefix, (0,)), (pivot, (-1, 0, 1))):
                r, letter = row[at], own[row[at]] + place[at]
                for side, (lo, hi) in enumerate(((offsets[r], start[letter + Q]), (start[letter], offsets[r + 1]))):
                    value = hashes(data, Spans(lo, hi, r, batch.num_rows))
                    for change in changes:
                        keys.append(mix(value + (2 * (length[r] + change) + side).astype(np.uint64)).view(np.int64))
                        rows.append(r)
                        probes.append(np.full(len(r), len(changes) > 1))
            r = np.concatenate(rows)
            columns = [np.concatenate(keys), np.concatenate(probes), batch.column("word").take(pa.array(r)), last[r].astype(np.int32), signature[r]]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["key", "probe", "word", "last", "signature"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): the pairs of distinct ``word`` that one inserted, deleted or replaced letter tells apart, each once."""
    counts = words.mapInArrow(_bigram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    often = np.zeros(_LETTERS * _LETTERS, dtype=np.int64)
    for gram, n in counts:
        often[gram] = n
    rows = materialize(words.select("word").mapInArrow(Index(often), "key long, probe boolean, word string, last int, signature long"), "pivotal_bigrams")
    side = lambda name: ["key", *(F.col(c).alias(f"{c}_{name}") for c in ("word", "last", "signature"))]
    both = rows.filter("probe").select(*side("a")).join(rows.filter("NOT probe").select(*side("b")), "key").filter("last_a <= last_b")
    # a replaced letter takes Q bigrams out and puts Q others in; an inserted or deleted one changes fewer
    alike = F.bit_count(F.col("signature_a").bitwiseXOR(F.col("signature_b"))) <= 2 * Q * TAU
    a, b = F.col("word_a"), F.col("word_b")
    found = both.filter(F.when(alike, (a != b) & (F.levenshtein(a, b, TAU) == TAU)).otherwise(False)).select(a.alias("a"), b.alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: links are followed with doubled steps, so rounds grow with the log of a chain."""
    at = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "form_links")
    while not at.filter("open").isEmpty():
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = at.join(step, "root", "left")
        at = materialize(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")), "form_links")
    return at.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text).

    Null and empty texts have no words; a row without doc_id counts as one with
    an empty doc_id. Repeated rows count as often as they stand there. Words
    that tie in n are taken in code-point order. Other columns are ignored; no
    documents give no words.
    """
    words = materialize(vocabulary(docs), "vocabulary")
    pairs = materialize(near_pairs(words), "near_words")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = sides.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    nearest = counted.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    own: Column = -F.col("best.less")
    joined = words.join(nearest, "word", "left").withColumn("big", own >= 2 * F.col("n"))
    joined = materialize(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("big"), F.col("best.near")).alias("form"), F.when(F.col("big"), own).alias("form_n")), "forms")
    ends = roots(joined.filter("form IS NOT NULL").select("word", "form"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL for the query, over a view ``documents``. Near words are those that agree without one letter, or without one at the same place.
ORACLE = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w
  FROM documents),
c AS (SELECT w, count(*) AS n, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM r WHERE length(w) >= {MIN_LENGTH} GROUP BY doc_id, w),
e AS (SELECT CASE WHEN h % {EDITED} = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
x AS (SELECT word, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
b AS (SELECT p.word, count(*) AS n_near, min((-v.n, v.word)) AS best FROM p JOIN v ON v.word = p.near GROUP BY p.word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * v.n THEN -best[1] END AS form_n
  FROM v LEFT JOIN b ON b.word = v.word),
t AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, t.root FROM f JOIN t ON f.form = t.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word
"""
