"""Language identification by prediction with partial matching.

Every language has a tree of byte contexts up to ORDER bytes long. A byte seen
in a context is predicted from its count there; an escape, whose probability
grows with the number of different bytes seen, leads to the next shorter
context, without the bytes already refused. Statistics are frozen after
training, so the trees unfold into one table: context and byte to code length
in every language. A text's language is the one that codes it in fewest bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.common import nested, small_batches
from funnelspark.llm.textarrays import utf8

ORDER = 3
#: Training reads about this many rows of each language, drawn evenly by a hash of the id.
ROWS_PER_LANGUAGE = 2000
#: A context of ORDER bytes gets a place of its own in the tree from this many occurrences on.
MIN_CONTEXT = 16
#: Bits that one more bit of code length difference counts for in the score; bytes of a text aren't independent.
EVIDENCE = 0.1
#: A text that no language codes in fewer bits than its bytes hold is in none of them.
MOST_BITS = 8.0
UNKNOWN = "und"
LETTER = r"\p{L}"


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(LETTER), F.lit(False))


@dataclass
class Model:
    """languages; class of each byte; row of each context; code length in bits by (row, class, language)."""

    languages: list[str]
    symbol: np.ndarray
    rows: np.ndarray
    bits: np.ndarray


def _keys(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """``order`` bytes before each byte and the byte itself, packed; line feeds stand before a text."""
    key = data.astype(np.uint32)
    for back in range(1, order + 1):
        before = np.full(len(data), 10, dtype=np.uint32)
        before[back:] = data[:-back] if back < len(data) else 0
        at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        before[at < back] = 10
        key |= before << np.uint32(8 * back)
    return key


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        lang = batch.column("lang").dictionary_encode()
        names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        data, offsets = utf8(batch.column("text"))
        by_byte = np.repeat(code, np.diff(offsets))
        keys = _keys(data, offsets, ORDER)
        for i, name in enumerate(names):
            key, n = np.unique(keys[by_byte == i], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(key)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])


def _spread(seen: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with counts ``seen`` whose shorter contexts have probabilities ``below``."""
    total, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
    left = np.where(seen > 0, 0.0, below)
    mass = left.sum(axis=1, keepdims=True)
    # a context that has seen every class has nothing to escape to
    escape = np.where(mass > 0, kinds / np.maximum(total + kinds, 1), 0.0)
    escape = np.where(total == 0, 1.0, escape)
    share = np.where(seen > 0, seen / np.maximum(total, 1) * (1 - escape), 0.0)
    return share + escape * left / np.where(mass > 0, mass, 1.0)


def build(counts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """The unfolded trees of (language, packed context and byte, occurrences)."""
    languages = [name for name, _, _ in counts]
    seen = np.zeros(256, dtype=bool)
    for _, key, _ in counts:
        for back in range(ORDER + 1):
            seen[np.unique((key >> (8 * back)) & 255)] = True
    seen[10] = True
    used = np.flatnonzero(seen)
    symbol = np.full(256, len(used), dtype=np.int32)  # one class for all other bytes
    symbol[used] = np.arange(len(used))
    size = len(used) + 1
    others = 256 - len(used)

    unpacked = []
    for _, key, n in counts:
        parts = [symbol[(key >> (8 * back)) & 255] for back in range(ORDER, -1, -1)]
        unpacked.append((parts, n))

    def context(parts: list[np.ndarray], order: int) -> np.ndarray:
        out = np.zeros(len(parts[0]), dtype=np.int64)
        for p in parts[ORDER - order : ORDER]:
            out = out * size + p
        return out

    # contexts of every order that any language keeps, and the row of each in the table
    rows = np.zeros(size**ORDER, dtype=np.int32)
    shape = rows.reshape((size,) * ORDER)
    order_keys, parents = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    first = 1
    index = np.zeros(1, dtype=np.int64)
    for order in range(1, ORDER + 1):
        total = np.zeros(size**order, dtype=np.int64)
        for parts, n in unpacked:
            np.add.at(total, context(parts, order), n)
        keys = np.flatnonzero(total >= (MIN_CONTEXT if order == ORDER else 1))
        parents.append(index[keys % size ** (order - 1)])
        index = index[np.arange(size**order) % size ** (order - 1)]
        index[keys] = first + np.arange(len(keys))
        first += len(keys)
        order_keys.append(keys)
    shape[...] = index.reshape(shape.shape)

    bits = np.zeros((first, size, len(languages)), dtype=np.float32)
    for j, (parts, n) in enumerate(unpacked):
        flat = np.full(size, 1 / 256)
        flat[-1] = others / 256
        chance = np.zeros((first, size))
        start = 0
        for order, keys in enumerate(order_keys):
            place = np.full(size**order, -1, dtype=np.int64)
            place[keys] = np.arange(len(keys))
            at = place[context(parts, order)]
            counted = np.zeros((len(keys), size))
            np.add.at(counted, (at[at >= 0], parts[ORDER][at >= 0]), n[at >= 0])
            below = chance[parents[order]] if order else flat[None, :]
            chance[start : start + len(keys)] = _spread(counted, below)
            start += len(keys)
        # a byte of the class of all others shares the class's probability
        if others:
            chance[:, -1] /= others
        else:
            chance[:, -1] = 1 / 256
        bits[:, :, j] = -np.log2(np.maximum(chance, 1e-12))
    return Model(languages, symbol, rows, bits.reshape(first * size, len(languages)))


def train(rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Counted contexts of each language in ``rows`` (doc_id, text, lang), from about ``rows_per_language`` rows of each.

    The counts are bounded by the number of distinct ORDER + 1 byte sequences in
    those rows; they are what the driver gathers.
    """
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # one entry for each language
    sizes = usable.groupBy("lang").agg(F.count("*").alias("rows")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "rows")))).scalar()
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) * F.element_at(sizes, F.col("lang")) < (rows_per_language << 30))
    counted = drawn.select("lang", "text").mapInArrow(_count_batches, "lang string, key long, n long")
    table = counted.groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    out = []
    for name in sorted(pc.unique(table["lang"]).to_pylist()):
        part = table.filter(pc.equal(table["lang"], name))
        out.append((name, part["key"].to_numpy(), part["n"].to_numpy()))
    return out


_models: dict[str, Model] = {}


def code_lengths(column: pa.Array, model: Model) -> np.ndarray:
    """Bits of each text in each language."""
    data, offsets = utf8(column)
    size = int(model.symbol.max()) + 1
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    at = model.symbol[data]
    place = np.zeros(len(data), dtype=np.int64)
    feed = int(model.symbol[10])
    first = offsets[:-1][np.diff(offsets) > 0]
    for back in range(ORDER, 0, -1):
        before = np.full(len(data), feed, dtype=np.int64)
        before[back:] = at[:-back] if back < len(data) else feed
        for k in range(back):  # line feeds stand before a text
            cut = first + k
            before[cut[cut < len(data)]] = feed
        place *= size
        place += before
    # a byte near the start of a text of fewer than ORDER bytes may belong to the next text; its context is right as well
    used = np.take(model.bits, model.rows[place].astype(np.int64) * size + at, axis=0)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if len(filled):
        out[filled] = np.add.reduceat(used, offsets[filled], axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, counts: list[tuple[str, np.ndarray, np.ndarray]]) -> DataFrame:
    """``docs`` (doc_id, text and any others) with lang_pred, score and bits_per_byte; other columns than text are passed on.

    bits_per_byte is the code length in the predicted language, null without one. Null texts and texts without a letter are ``und`` with score 0, as is all
    text if nothing was learned. Ties go to the language first in the alphabet.
    """
    kept = [f for f in docs.schema.fields if f.name != "text"]
    name = f"{len(counts)}-{sum(hash((c[0], len(c[1]), int(c[2].sum()))) for c in counts)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if counts and name not in _models:
            _models.clear()
            _models[name] = build(counts)
        for batch in small_batches(batches, "text", 1 << 19):
            clear = batch.column("_letter").to_numpy(zero_copy_only=False)
            lang, score = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            density, known = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=bool)
            if counts:
                model = _models[name]
                bits = code_lengths(batch.column("text"), model)
                best = bits.argmin(axis=1)
                behind = bits - bits[np.arange(len(best)), best][:, None]
                lang = np.where(clear, np.array(model.languages, dtype=object)[best], UNKNOWN)
                score = np.where(clear, 1 / np.exp2(-EVIDENCE * behind).sum(axis=1), 0.0)
                size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
                density, known = bits.min(axis=1) / np.maximum(size, 1), clear
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(density, mask=~known)],
                names=[*(f.name for f in kept), "lang_pred", "score", "bits_per_byte"])

    schema = docs.select(*(f.name for f in kept)).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return docs.withColumn("_letter", has_letter(F.col("text"))).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Learns only from rows that aren't held out and have a language. Extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    counts = train(rows.filter(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), counts).drop("bits_per_byte")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language; columns stay as they are.

    Texts without a letter go, null ones included, and texts that their nearest
    language codes in ``MOST_BITS`` a byte or more. Where no row has a language
    to learn from, all rows stay.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    counts = train(rows.filter(~F.col("held_out")))
    if not counts:
        return docs

    def identified(own: DataFrame) -> DataFrame:
        found = predict(own.withColumn("whole_text", F.col("text")), counts)
        return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < MOST_BITS)).withColumnRenamed("whole_text", "text")

    return nested(docs, identified)
