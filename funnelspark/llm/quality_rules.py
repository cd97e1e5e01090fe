"""Quality rules: counted properties of a text, then tokeniser fertility.

Fertility is measured with a public vocabulary that spells unknown characters
as bytes: characters per token, share of tokens that are single bytes, and the
entropy of a text's tokens relative to what its length allows. Every language
or script has its own band of values; a text outside is rejected. Bands come
from the corpus itself (median and interquartile range over all its texts), or
from the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.common import materialize, small_batches
from funnelspark.llm.fertility import Vocabulary
from funnelspark.llm.textarrays import distinct, grams, hashes, is_space, lines, sorted_in_rows, utf8, words

VOCABULARY = "piece_bpe_32k.model"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Half widths of a band, in interquartile ranges on either side of the quartiles.
SPREAD = 6.0
#: A band needs this many texts; groups with fewer use the band of all texts.
MIN_TEXTS = 50
MEASURES = ("chars_per_token", "byte_share", "token_entropy")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sum_by(spans, flag: np.ndarray) -> np.ndarray:
    """How many flagged bytes each span holds."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(flag, dtype=np.int64)])
    return sums[spans.end] - sums[spans.start]


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Counted properties of each text; null counts as empty."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    spans = words(data, offsets)
    n_words = spans.counts()
    total = lambda flag: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(flag, dtype=np.int64)])[offsets])
    points = (data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": total(points & ~is_space(data)), "n_symbols": total(_SYMBOL[data])}

    each = lines(data, offsets)
    used = _sum_by(each, ~is_space(data)) > 0
    each.start, each.end, each.row = each.start[used], each.end[used], each.row[used]
    row, _, times = distinct(each.row, hashes(data, each))
    out["n_dup_lines"] = np.bincount(row, weights=times - 1, minlength=n).astype(np.int64)

    # words that lie in a window whose words occur at two places or more
    value, row = grams(hashes(data, spans), spans.row, WINDOW)
    order = sorted_in_rows(row, value, places=True)
    r, v = row[order], value[order]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    twice = np.zeros(len(r), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = np.flatnonzero(spans.row[: max(len(spans.row) - WINDOW + 1, 0)] == spans.row[WINDOW - 1 :])
    edge = np.zeros(len(spans.row) + 1, dtype=np.int64)
    at = first[order[twice]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(spans.row[np.cumsum(edge)[:-1] > 0], minlength=n)
    return out


def measure(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, lang and every count and fertility measure of each row."""
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
        "script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary.of(vocabulary)
        for batch in small_batches(batches, "text"):
            text = batch.column("text")
            have = counts(text)
            rows = model.fertility(text)
            columns = [batch.column("doc_id"), batch.column("lang"), *(pa.array(x.astype(np.int64)) for x in have.values()), *rows]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def bands(measured: DataFrame, spread: float = SPREAD, min_texts: int = MIN_TEXTS) -> DataFrame:
    """A band per language and measure, and one for all texts (band null).

    Quartiles are taken over the texts with at least MIN_WORDS words, mergeable
    summaries per language, so that a language of any share is combined before
    the shuffle.
    """
    usable = measured.filter((F.col("n_words") >= MIN_WORDS) & (F.col("n_tokens") > 0))
    usable = usable.withColumn("band", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), F.coalesce("lang", "script")))))
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10000).alias(m) for m in MEASURES]
    table = usable.groupBy("band").agg(F.count("*").alias("texts"), *quartiles)
    out = table.filter((F.col("texts") >= min_texts) | (F.col("band") == "*"))
    for m in MEASURES:
        # a spread of nearly nothing would reject texts for rounding
        width = F.greatest(F.col(m)[2] - F.col(m)[0], F.abs(F.col(m)[1]) * 0.02, F.lit(0.005)) * spread
        out = out.withColumn(f"{m}_low", F.col(m)[0] - width).withColumn(f"{m}_high", F.col(m)[2] + width)
    return out.select("band", *(f"{m}_{e}" for m in MEASURES for e in ("low", "high")))


def quality(docs: DataFrame, vocabulary: str | None = None, band_table: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, optional lang) with counts, measures and verdicts.

    ``base_failed`` holds for fewer than 20 words or more than 30 % of words in
    repeated windows; such a text isn't kept. Others are kept if every measure
    lies in the band of their language (its script where lang is null), or in
    the band of all texts where that language has few texts. Null text counts
    as empty. Repeated rows are judged alike; extra columns are ignored.
    """
    import public_tokenizers

    measured = materialize(measure(docs, vocabulary or public_tokenizers.path(VOCABULARY)), "fertility")
    table = band_table if band_table is not None else materialize(bands(measured), "bands")
    whole = table.filter("band = '*'").drop("band")
    whole = whole.select(F.struct(*whole.columns)).scalar()
    own = table.filter("band != '*'").select(F.col("band"), F.struct(*[c for c in table.columns if c != "band"]).alias("own"))
    held = measured.withColumn("band", F.concat(F.lit("="), F.coalesce("lang", "script"))).join(own, "band", "left")
    held = held.withColumn("own", F.coalesce("own", whole))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col("own")[f"{m}_low"], F.col("own")[f"{m}_high"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return held.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(True))).alias("kept"), "script", "n_tokens", *MEASURES,
    )
