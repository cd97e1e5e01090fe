"""Helpers that several operators of this package share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.session import materialize, scratch_path

__all__ = ["bounded_rows", "crc32_sql", "let", "materialize", "nested", "read_table", "replace_text", "scratch_path", "small_batches", "with_row_key"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """DuckDB SQL: crc32 of the UTF-8 bytes of a text of characters up to U+007F and from U+00C0 to U+00FF."""
    table = ",".join(str(zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF) for i in range(256))
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
    step = f"xor(([{table}])[xor(s, b) % 256 + 1], s >> 8)"
    return f"xor(4294967295, list_reduce(list_transform({codes}, lambda b: CAST(b AS BIGINT)), lambda s, b: {step}, 4294967295))"


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row from its id and content; nulls count as values of their own."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*parts)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def nested(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], known: tuple[str, ...] = ("doc_id", "text", "lang", "n_chars")) -> DataFrame:
    """``stage`` of ``docs`` with the columns of ``docs``; those it doesn't know travel in one struct, so their names can't clash."""
    own, other = [c for c in docs.columns if c in known], [c for c in docs.columns if c not in known]
    if not other:
        return stage(docs).select(*own)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    out = stage(docs.select(*own, F.struct(*(F.col(quoted(c)) for c in other)).alias("other_columns")))
    return out.select(*(F.col(c) if c in own else F.col(f"other_columns.{quoted(c)}").alias(c) for c in docs.columns))


def replace_text(docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """``docs`` with a new ``text``; ``n_chars``, where there is one, follows it in rows that ``changed``."""
    out = docs.withColumns({"_changed": changed, "text": text})
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_changed"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop("_changed")


def with_row_key(docs: DataFrame, name: str = "row_key") -> DataFrame:
    return docs.withColumn(name, row_key("doc_id", "text"))


def bounded_rows(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows with the ``most`` smallest distinct values of ``key``, evenly drawn if ``key`` is a hash.

    Only the keys are sorted; the rows themselves are read with a filter. Rows
    that share a key are one row, so at most ``most`` rows come back.
    """
    keyed = rows.withColumn("_draw", key)
    cut = keyed.select("_draw").distinct().orderBy("_draw").limit(most).agg(F.max("_draw")).scalar()
    return keyed.filter(F.col("_draw") <= cut).dropDuplicates(["_draw"]).drop("_draw")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most_bytes`` of text each, one row at least; a row counts as 1,000 bytes more."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        sizes = sizes + 1000
        group = (np.cumsum(sizes) - sizes) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)
