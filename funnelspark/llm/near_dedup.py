"""MinHash near-dedup by fast similarity sketching.

A sketch has ``BINS`` coordinates. In round i every shingle is hashed to a bin
and a value; a bin takes the smallest value of the first round that reaches it.
The first BINS rounds choose the bin by hash, the next BINS rounds fill bin i
for certain, so that every coordinate is filled whatever the size of the set,
and a large set needs one round only. Two sets agree in a coordinate with
probability equal to their similarity, with Chernoff bounds over coordinates.

Bands of ``ROWS`` coordinates propose candidates; every link is confirmed on
the full sets of hashed shingles. At similarity 0.75 a pair misses all bands
with probability 5e-6.

Groups are never expanded to pairs. Equal sets are one class. Inside a bucket,
every class is compared with one leader of the bucket; in later rounds, with
leaders drawn by a hash for each band and for each pair of bands, but only
across components that aren't joined yet. Classes of buckets that still hold
several components beside their leader are then compared exactly: shingles are
ordered from the rarest, and a pair at the threshold has to share one among the
first of both, at places that leave room for the overlap. Every pair that these
bounds don't rule out is tested, so no link inside a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.common import materialize, nested, small_batches
from funnelspark.llm.textarrays import mix, shingles, sorted_in_rows

WORDS = 5
THRESHOLD = 75
BINS = 128
ROWS = 4
ROUNDS = ("leader", "drawn", "pairs")

_SEEDS = np.random.default_rng(8).integers(1, 2**63, 2 * BINS, dtype=np.uint64)


def sketches(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Sketches of shingle sets given as (row, hash); rows without shingles hold zeros."""
    out = np.full((rows, BINS), np.iinfo(np.uint64).max, dtype=np.uint64)
    empty = out[0, 0] if rows else 0
    bits = np.uint64(64 - BINS.bit_length() + 1)
    for i in range(2 * BINS):
        active, local = np.unique(row, return_inverse=True)
        if not len(active):
            break
        x = mix(value ^ _SEEDS[i])
        bin_ = (x >> bits).astype(np.int64) if i < BINS else np.full(len(x), i - BINS)
        low = x & ((np.uint64(1) << bits) - np.uint64(1))
        found = np.full(len(active) * BINS, empty, dtype=np.uint64)
        np.minimum.at(found, local * BINS + bin_, low)
        found = found.reshape(-1, BINS)
        # the round goes into the coordinate, so that values of different rounds differ
        found = np.where(found == empty, empty, mix(found + _SEEDS[i]) >> np.uint64(1))
        held = out[active]
        out[active] = held = np.where(held == empty, found, held)
        open_ = (held == empty).any(axis=1)
        keep = open_[local]
        row, value = row[keep], value[keep]
    out[out == empty] = 0
    return out


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        row, value = shingles(batch.column("text"), WORDS)
        n = np.bincount(row, minlength=batch.num_rows)
        sketch = sketches(row, value, batch.num_rows)
        bands = np.zeros((batch.num_rows, BINS // ROWS), dtype=np.uint64)
        for j in range(ROWS):
            bands = mix(bands + sketch[:, j::ROWS] * np.uint64(2 * j + 3))
        digests = []
        for seed in (3, 5):  # sums of mixed members: a digest of the set
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(seed)), dtype=np.uint64)])
            end = np.cumsum(n)
            digests.append((total[end] - total[end - n]).astype(np.int64))
        flat = pa.array(bands.astype(np.int64).ravel())
        offsets = pa.array(np.arange(0, flat.__len__() + 1, BINS // ROWS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(n.astype(np.int64)), *map(pa.array, digests), pa.ListArray.from_arrays(offsets, flat)],
            names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands"],
        )


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts -> the pairs at or over the threshold."""
    for batch in small_batches(batches, "text_b", 1 << 19):
        sides = [shingles(batch.column(c), WORDS) for c in ("text_a", "text_b")]
        (ra, va), (rb, vb) = sides
        row, value = np.concatenate([ra, rb]), np.concatenate([va, vb])
        order = np.argsort(row, kind="stable")
        row = row[order]
        value = sorted_in_rows(row, value[order])
        both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=batch.num_rows)
        union = np.bincount(row, minlength=batch.num_rows) - both
        keep = pa.array((100 * both >= THRESHOLD * union) & (union > 0))
        yield batch.select(["a", "b"]).filter(keep)


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        row, value = shingles(batch.column("text"), WORDS)
        n = np.bincount(row, minlength=batch.num_rows)
        rep = batch.column("rep").to_numpy()
        component = batch.column("component").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[row], component[row], n[row].astype(np.int64), value.view(np.int64))], names=["rep", "component", "n", "shingle"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge, by alternating star contractions.

    Each step is two grouped minima and joins; no neighbourhood is collected.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        # done when every node has one edge, to a node that has none itself
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out")))
        open_ = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("n")).filter("out > 1 OR (out = 1 AND n > 1)")
        if open_.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        edges = materialize(small, "edges")


def _buckets(classes: DataFrame, step: int = 0) -> DataFrame:
    """(key, rep, n): the buckets of each class, by one band or by two bands ``step`` apart."""
    last = F.lit(BINS // ROWS)
    parts = F.transform(F.col("bands"), lambda h, i: F.xxhash64(i, h, F.element_at("bands", (i + step) % last + 1)) if step else F.xxhash64(i, h))
    return classes.select("rep", "n", F.explode(parts).alias("key"))


def _candidates(inside: DataFrame, kind: str) -> DataFrame:
    """Pairs (a, b) of a bucket's leader and its other classes in other components, where sizes allow a link."""
    rank = F.struct("rep", "n", "component") if kind == "leader" else F.struct(
        F.xxhash64("key", "rep").alias("draw"), "rep", "n", "component")
    leaders = inside.groupBy("key").agg(F.min(rank).alias("top"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1")
    leaders = leaders.select("key", F.col("top.rep").alias("lead"), F.col("top.n").alias("lead_n"), F.col("top.component").alias("lead_c"))
    fits = (100 * F.least("n", "lead_n") >= THRESHOLD * F.greatest("n", "lead_n")) & (F.col("component") != F.col("lead_c"))
    pairs = inside.join(leaders, "key").filter(fits)
    return pairs.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()


def _open_classes(members: DataFrame) -> DataFrame:
    """(rep, component) of the classes of buckets where pairs besides those of the first leader are unjoined."""
    leaders = members.groupBy("key").agg(F.min("rep").alias("lead"))
    rest = members.join(leaders, "key").filter("rep != lead")
    open_ = rest.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1").select("key")
    return rest.join(open_, "key", "left_semi").select("rep", "component").distinct()


def _exact_pairs(classes: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) of (rep, component) classes in other components that the bounds on sizes and on rarest shingles allow.

    With shingles ordered from the rarest, the first that two sets share stands
    among the first n - ceil(2 t n / (1 + t)) + 1 of the smaller set and the first
    n - ceil(t n) + 1 of the larger, and the rest has to hold the overlap.
    Shingles of one class alone come first; they only take up places.
    """
    ceil = lambda top, below: F.floor((top + (below - 1)) / below)
    texts = held.withColumnRenamed("doc_id", "rep").join(classes, "rep").select("rep", "component", "text")
    every = materialize(texts.mapInArrow(_shingle_batches, "rep long, component long, n long, shingle long"), "open_shingles")
    often = every.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    sets = every.join(often, "shingle").groupBy("rep", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    placed = F.transform("s", lambda x, i: F.struct(x["shingle"].alias("shingle"), (F.col("n") - F.size("s") + i + 1).alias("place")))
    first = F.filter(placed, lambda x: x["place"] <= F.col("n") - ceil(THRESHOLD * F.col("n"), 100) + 1)
    rows = materialize(sets.select("rep", "component", "n", F.explode(first).alias("x")).select("rep", "component", "n", "x.*"), "rare_shingles")
    small = rows.filter(F.col("place") <= F.col("n") - ceil(2 * THRESHOLD * F.col("n"), 100 + THRESHOLD) + 1)
    small = small.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("rep", "component", "n", "place")))
    room = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n") - F.col("place"))
    pairs = rows.join(small.hint("merge"), "shingle").filter(
        (F.struct("n_a", "rep_a") < F.struct("n", "rep")) & (F.col("component") != F.col("component_a"))
        & (100 * F.col("n_a") >= THRESHOLD * F.col("n")) & ((100 + THRESHOLD) * room >= THRESHOLD * (F.col("n") + F.col("n_a"))))
    return pairs.select(F.least("rep", "rep_a").alias("a"), F.greatest("rep", "rep_a").alias("b")).distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and first (doc_id and text_hash of the group's first text) of every row.

    Classes of equal sets go by numbers of their own, as several texts may share
    a doc_id; a group takes the smallest doc_id of its classes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    kind = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bands array<long>"
    sets = materialize(texts.mapInArrow(_sketch_batches, kind), "sketches")
    usable = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = usable.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("bands").alias("bands"))
    classes = materialize(same.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # buckets of two classes or more, and the texts of those classes, taken out of the documents once
    spread = _buckets(classes)
    shared = spread.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    inside = materialize(spread.join(shared, "key", "left_semi"), "buckets")
    wanted = materialize(inside.select("rep").distinct(), "wanted")
    named = classes.join(wanted, "rep").select("rep", "first.doc_id", "first.text_hash")
    held = texts.join(named, ["doc_id", "text_hash"]).dropDuplicates(["rep"]).select(F.col("rep").alias("doc_id"), "text")
    held = materialize(held, "candidate_texts")
    grouped = classes.join(wanted, "rep", "left_semi")

    confirmed = tested = label = None
    for kind in (*ROUNDS, "exact"):
        members = _buckets(grouped, 1) if kind == "pairs" else inside
        if label is None:
            members = members.withColumn("component", F.col("rep"))
        else:
            members = members.join(label, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
        if kind == "exact":
            open_ = materialize(_open_classes(members), "open_classes")
            if open_.isEmpty():
                continue
        pairs = _exact_pairs(open_, held) if kind == "exact" else _candidates(members, kind)
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        sided = pairs.join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        sided = sided.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        found = materialize(sided.select("a", "b", "text_a", "text_b").mapInArrow(_confirm_batches, "a long, b long"), "confirmed")
        if found.isEmpty():
            continue
        confirmed = found if confirmed is None else confirmed.unionByName(found)
        label = components(confirmed)
    member = classes.drop("bands")
    if label is not None:
        member = member.join(label, F.col("rep") == F.col("node"), "left").withColumn("group", F.coalesce("component", "rep")).drop("node", "component")
        least = member.groupBy("group").agg(F.min("first").alias("least"))
        member = member.join(least, "group").withColumn("first", F.col("least")).drop("least", "group")
    rows = sets.select("doc_id", "text_hash", "d1", "d2", F.col("n_shingles").alias("n"))
    component = F.when(F.col("n") > 0, F.least("doc_id", "first.doc_id")).otherwise(F.col("doc_id"))
    return rows.join(member.drop("rep"), ["d1", "d2", "n"], "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingle and are linked with nothing, as
    are rows without doc_id (component_id null, kept). Repeated rows are one
    document; texts that differ under one doc_id are linked each on its own.
    Extra columns are ignored.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _grouped(docs).select("doc_id", "n_shingles", "component_id").withColumn("kept", kept)


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: of the text with the smallest doc_id, and of texts that share it one.

    Texts without shingles and rows without doc_id are no group, but of rows that
    agree in doc_id and text one stays.
    """
    def first_rows(own: DataFrame) -> DataFrame:
        hashed = own.withColumns({"row_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64(F.col("text").cast("string"))})
        verdicts = materialize(_grouped(own), "groups")
        is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
        later = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & ~is_first
        gone = verdicts.filter(later).select(F.col("doc_id").alias("row_id"), "text_hash").distinct()
        left = hashed.join(gone, ["row_id", "text_hash"], "left_anti")
        # only rows that stand there twice are compared with each other
        twice = verdicts.filter(~F.coalesce(later, F.lit(False))).groupBy(F.col("doc_id").alias("same_id"), F.col("text_hash").alias("same_hash")).agg(F.count("*").alias("n")).filter("n > 1")
        same = F.col("row_id").eqNullSafe(F.col("same_id")) & (F.col("text_hash") == F.col("same_hash"))
        single = left.join(twice, same, "left_anti")
        return single.unionByName(left.join(twice, same, "left_semi").dropDuplicates(["row_id", "text_hash"]))

    return nested(docs, first_rows)
