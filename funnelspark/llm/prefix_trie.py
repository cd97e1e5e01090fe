"""Prefix trie of conversations, rolled up by depth bands.

A conversation is a path of turns from the root; conversations that begin with
the same turns share their first nodes. A turn is known by a digest of its role
and text, a node by its depth and two 64-bit hashes that all turns up to it are
xored into, each with its place. Running values are made in two levels, inside
chunks of range-partitioned rows and over the chunks of a conversation, so that
even a conversation with most of the rows needs no task of its own.

Totals of subtrees (leaves, saved tokens) come up in bands of ``BAND`` depths:

1. A node gives its values to its ancestors inside its band only, so a row of a
   path has at most ``BAND`` values to hand out, added up within the row.
2. The bands' roots form a trie of their own, ``BAND`` times less deep, rolled
   up in the same way; that completes the totals of all band roots.
3. Each completed band root gives its total to the ancestors in the band above.

Rounds grow with the logarithm of the depth to the base ``BAND``. A node is
named by its depth and the smallest conversation that goes through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.llm.common import crc32_sql, materialize

BAND = 16
HEADS = 9  # a conversation takes up to HEADS - 1 turns of the first of its FAMILY
FAMILY = 5


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, bytes of the text; texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    known = conversations.filter(F.col("conv_id").isNotNull())
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``k``, the number from 1 of each row within its conversation and partition."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        start = np.repeat(new, np.diff(np.append(new, len(conv))))
        k = np.arange(len(conv)) - start + 1
        if conv[0] == last:
            k[start == 0] += count
        last, count = conv[-1], int(k[-1])
        yield batch.append_column("k", pa.array(k))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place from 1), part, digest, bytes.

    Rows are range-partitioned, so that a long conversation spreads over tasks;
    rows alike in all columns are told apart by their row number, whichever gets
    which. Each part counts its own rows; counts of earlier parts are added.
    """
    order = ["conv_id", "turn", "digest"]
    rows = _turns(conversations).withColumn("at", F.monotonically_increasing_id())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order, "at").sortWithinPartitions(*order, "at")
    parts = sorted_.select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"))
    numbered = materialize(parts.mapInArrow(_numbered, "conv_id long, digest binary, bytes long, part int, k long"), "numbered_turns")
    chunks = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return numbered.join(before, ["conv_id", "part"]).withColumn("i", F.col("k") + F.col("before")).drop("k", "before")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, d, part, digest, bytes), and their lengths (conv_id, length).

    ``d`` is the place from 1. Turns taken from the family's first conversation have part -1.
    """
    turns = materialize(ordered_turns(conversations), "ordered_turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    sizes = sizes.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    sizes = materialize(sizes, "conversation_sizes")
    own = turns.join(sizes.select("conv_id", "h", "taken"), "conv_id").filter("i > h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("d"), "part", "digest", "bytes")
    heads = turns.filter(F.col("i") < HEADS).withColumnRenamed("conv_id", "base")
    heads = heads.join(sizes.select("base", "conv_id", "taken"), "base").filter("i <= taken")
    heads = heads.select("conv_id", F.col("i").alias("d"), F.lit(-1).alias("part"), "digest", "bytes")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return heads.unionByName(own), sizes.select("conv_id", length.alias("length"))


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, d, bytes, key (hashes of all turns up to d), above (those up to d - 1)."""
    hashed = turns.select("conv_id", "part", "d", "bytes", *(F.xxhash64(F.lit(j), "digest", "d").alias(f"x{j}") for j in (1, 2)))
    hashed = materialize(hashed, "hashed_turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = hashed.groupBy("conv_id", "part").agg(*(F.bit_xor(f"x{j}").alias(f"x{j}") for j in (1, 2)))
    chunks = chunks.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"x{j}").over(earlier), F.lit(0)).alias(f"o{j}") for j in (1, 2)))
    inside = Window.partitionBy("conv_id", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("*", *(F.bit_xor(f"x{j}").over(inside).alias(f"p{j}") for j in (1, 2))).join(chunks, ["conv_id", "part"])
    whole = [F.col(f"p{j}").bitwiseXOR(F.col(f"o{j}")) for j in (1, 2)]
    return running.select(
        "conv_id", "d", "bytes", F.struct(whole[0].alias("a"), whole[1].alias("b")).alias("key"),
        F.struct(*(w.bitwiseXOR(F.col(f"x{j}")).alias(c) for j, w, c in zip((1, 2), whole, "ab"))).alias("above"))


def rollup(rows: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """(d, m) and the sums of ``values`` over each node's subtree.

    ``rows`` has a row (conv_id, d, m) for each conversation and depth that it
    reaches, m naming the node, and the node's own values on the row where
    conv_id is m. Names have to be the smallest conversation of each node.
    """
    own = F.col("conv_id") == F.col("m")
    # each row belongs to its band; a band's root stands at the foot of the band above as well
    both = F.array(F.struct((F.floor(F.col("d") / band)).alias("band"), F.lit(False).alias("foot")), F.struct((F.floor(F.col("d") / band) - 1).alias("band"), F.lit(True).alias("foot")))
    placed = rows.withColumn("at", F.explode(F.when((F.col("d") % band == 0) & (F.col("d") > 0), both).otherwise(F.slice(both, 1, 1))))
    entry = F.struct("d", "m", "at.foot", own.alias("own"), *values)
    path = placed.groupBy("conv_id", "at.band").agg(F.array_sort(F.collect_list(entry)).alias("path"), F.bool_or(own).alias("any_own"))
    paths = materialize(path.filter("any_own").select("conv_id", "path"), "banded_paths")

    def below(name: str, upper) -> F.Column:
        held = F.filter("path", lambda x: x["own"] & ~x["foot"] & (x["d"] >= upper["d"]))
        return F.aggregate(held, F.lit(0).cast("long"), lambda s, x: s + x[name])

    steps = F.transform(F.filter("path", lambda x: ~x["foot"]), lambda u: F.struct(u["d"].alias("d"), u["m"].alias("m"), *(below(v, u).alias(v) for v in values)))
    inside = paths.select(F.inline(steps)).groupBy("d", "m").agg(*(F.sum(v).alias(v) for v in values))
    if rows.filter(F.col("d") >= band).isEmpty():
        return inside
    inside = materialize(inside, "band_totals")
    roots = rows.filter(F.col("d") % band == 0).select("conv_id", "d", "m")
    roots = roots.join(inside.filter(F.col("d") % band == 0), ["d", "m"]).withColumn("d", (F.col("d") / band).cast("long"))
    whole = materialize(rollup(materialize(roots, "band_roots"), values, band), "band_root_totals")
    # completed band roots to their ancestors in the band above, along the path of the conversation that names the root
    foot = paths.withColumn("foot", F.get(F.filter("path", lambda x: x["foot"] & x["own"]), F.lit(0))).filter("foot IS NOT NULL")
    done = whole.select((F.col("d") * band).alias("foot_d"), F.col("m").alias("foot_m"), *values)
    risen = foot.join(done, (F.col("foot.d") == F.col("foot_d")) & (F.col("foot.m") == F.col("foot_m")))
    risen = risen.select(F.explode(F.filter("path", lambda x: ~x["foot"])).alias("u"), *values).select("u.d", "u.m", *values)
    return inside.unionByName(risen).groupBy("d", "m").agg(*(F.sum(v).alias(v) for v in values))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of ids in order of (d, m, first) -> a digest of each node's whole list, one list in memory at a time."""
    node, state = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"d": [node[0]], "m": [node[1]], "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        out = []
        for d, m, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "m", "ids"))):
            if (d, m) != node:
                if node is not None:
                    out.append(closed())
                node, state = (d, m), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if node is not None:
        yield closed()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, m, conv_id) in order -> a row for each run of a node in a batch: d, m, first conv_id, all of them joined."""
    for batch in batches:
        d, m, ids = (batch.column(c).to_numpy() for c in ("d", "m", "conv_id"))
        edges = [0, *(np.flatnonzero((np.diff(d) != 0) | (np.diff(m) != 0)) + 1).tolist(), len(d)]
        runs = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
        at = np.array([a for a, _ in runs], dtype=np.int64)
        joined = [",".join(map(str, ids[a:b].tolist())) for a, b in runs]
        yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(m[at]), pa.array(ids[at]), pa.array(joined, pa.string())], names=["d", "m", "first", "ids"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(d, m, ends_sha256) of rows (conv_id, d, m).

    Rows are dealt out by range, so a large group spreads over tasks that join
    its ids; the one task that takes a digest reads a row for thousands of ids.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["d", "m", "conv_id"]
    lists = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_lists, "d long, m long, first long, ids string")
    return lists.repartition("d", "m").sortWithinPartitions("d", "m", "first").mapInArrow(_digests, "d long, m long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Turns come by turn, null first; turns that tie by the digest of their role
    and text. Null roles and texts are empty. Rows without conv_id belong to no
    conversation. Repeated rows are turns of their own. Other columns are
    ignored; without conversations there is no node, not even the root.
    """
    turns, lengths = rebuilt_turns(conversations)
    lengths = materialize(lengths, "conversation_lengths")
    none = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    start = lengths.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("bytes"), none.alias("key"), F.lit(None).cast("struct<a:long,b:long>").alias("above"))
    paths = materialize(start.unionByName(_paths(turns)), "paths")

    nodes = paths.groupBy("d", "key").agg(F.min("conv_id").alias("m"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("above").alias("above"))
    nodes = materialize(nodes, "nodes")
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("above").alias("key")).agg(F.count("*").alias("n_children"))
    upper = nodes.select((F.col("d") + 1).alias("d"), F.col("key").alias("above"), F.col("m").alias("parent"))
    nodes = nodes.join(children, ["d", "key"], "left").join(upper, ["d", "above"], "left")
    nodes = materialize(nodes.select("d", "key", "m", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "bytes"), "linked_nodes")

    on_path = paths.select("conv_id", "d", "key").join(nodes.select("d", "key", "m", "n_convs", "n_children", "bytes"), ["d", "key"])
    own = F.col("conv_id") == F.col("m")
    rows = materialize(on_path.select(
        "conv_id", "d", "m", F.when(own, (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        F.when(own, (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "node_paths")
    totals = rollup(rows, ["n_leaves", "saved_tokens"], band)
    ends = rows.select("conv_id", "d", "m").join(lengths.select("conv_id", F.col("length").alias("d")), ["conv_id", "d"])
    out = nodes.drop("key", "bytes").join(totals, ["d", "m"]).join(ends_digests(ends), ["d", "m"], "left")
    return out.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: DuckDB SQL for the query, over a view ``conversations``.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS u, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, u, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(u)) AS i FROM t),
c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM o GROUP BY conv_id),
a AS (
  SELECT c.conv_id, 0 AS side, i, u, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {FAMILY} AND i <= h
  UNION ALL SELECT conv_id, 1, i, u, text FROM c JOIN o USING (conv_id) WHERE i > h),
d AS (SELECT conv_id, u, text, row_number() OVER (PARTITION BY conv_id ORDER BY side, i) AS d FROM a),
p AS (
  SELECT conv_id, d, strlen(text) AS bytes, md5(string_agg(md5(u), '' ORDER BY d) OVER w) AS k, string_agg(md5(u), '' ORDER BY d) OVER w AS whole
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '', '' FROM c),
n AS (SELECT d, k, min(conv_id) AS m, count(*) AS n_convs, max(bytes) AS bytes, max(whole) AS whole FROM p GROUP BY d, k),
r AS (SELECT p.conv_id, p.d, n.m FROM p JOIN n USING (d, k)),
e AS (SELECT n.*, (SELECT r.m FROM r WHERE r.conv_id = n.m AND r.d = n.d - 1) AS parent FROM n),
f AS (SELECT d - 1 AS d, parent AS m, count(*) AS n_children FROM e WHERE d > 0 GROUP BY 1, 2),
g AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN f USING (d, m)),
s AS (
  SELECT r.d, r.m, sum(CASE WHEN g.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((g.n_convs - 1) * g.bytes) AS saved
  FROM g JOIN r ON r.conv_id = g.m AND r.d <= g.d GROUP BY r.d, r.m),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
q AS (SELECT d, m, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM l JOIN r USING (conv_id, d) GROUP BY d, m)
SELECT m AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM g JOIN s USING (d, m) LEFT JOIN q USING (d, m)
"""
