"""Sharding by extendible hashing, in DataFrame functions only.

A row's hash is the first 60 bits of the MD5 of its key.  A shard is a prefix of the hash: the shortest one whose rows
have at most ``limit`` bytes together.  So the directory starts as one bucket of zero bits, and only oversized buckets
split, on one more bit each time, until every shard fits (or holds one row, which can't be split).

The bits are looked at in steps of 12.  A step counts the bytes of each cell (a prefix of all bits so far, at most
4,096 cells below one oversized cell), adds the cells up to the shorter prefixes, and leaves the cells that are still
too large for the next step.  Rows with equal keys have equal hashes; if they are still too large together at 60 bits,
they go on as an overflow directory, hashed with a number of their own as well.

Defined results: a null text has 0 bytes, a null key counts as the empty text.  A row larger than the limit is a shard
of its own.  An empty table has no shards.  The rows of a shard may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, small

LIMIT_BYTES = 64 << 20
BITS, STEP = 60, 12


def hash_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _cell(h: str | Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def _step(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Of the rows (_h, _n): the cells of ``high`` bits with the depth, bytes and rows of their shard, and the cells that fit no shard yet."""
    cells = rows.groupBy(_cell("_h", high).alias("cell")).agg(F.sum("_n").alias("b"), F.count(F.lit(1)).alias("n"))
    depths = F.explode(F.sequence(F.lit(low), F.lit(high)))
    each = cut(cells.select("cell", "b", "n", depths.alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)")), "cells")
    sums = each.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")).where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    best = F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("s")
    placed = cut(each.join(sums, ["depth", "prefix"]).groupBy("cell").agg(best).select("cell", "s.*"), "placed")
    open_cells = cut(each.where(F.col("depth") == high).select("cell").join(placed, "cell", "left_anti"), "open")
    return placed, open_cells, placed.count(), open_cells.count()


def _assign(rows: DataFrame, limit: int, mark: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows with shard, depth, shard_bytes and shard_docs; and rows with equal hashes that don't fit."""
    low, steps, below = 0, [], rows.select("_h", "_n")
    n_open = 0
    while low < BITS:
        high = min(BITS, low + STEP) if low else STEP
        placed, open_cells, n, n_open = _step(below, low + 1 if low else 0, high, limit)
        steps.append((high, placed, n))
        if not n_open:
            break
        below = below.withColumn("cell", _cell("_h", high)).join(small(open_cells, n_open), "cell", "left_semi").select("_h", "_n")
        low = high
    out = rows
    found = ["depth", "shard_bytes", "shard_docs"]
    for k, (high, placed, n) in enumerate(steps):
        named = placed.select(F.col("cell").alias(f"_c{k}"), *[F.col(x).alias(f"_{x}{k}") for x in found])
        out = out.join(small(named, n), _cell("_h", high) == F.col(f"_c{k}"), "left")
    got = {x: F.coalesce(*[F.col(f"_{x}{k}") for k in range(len(steps))]) for x in found}
    out = out.select(*rows.columns, *[c.alias(x) for x, c in got.items()])
    bits = F.lpad(F.bin(F.expr(f"shiftright(_h, {BITS} - depth)")), F.lit(BITS), "0")
    shard = F.concat(F.lit(mark), F.substring(bits, F.lit(BITS + 1) - F.col("depth"), F.col("depth")))
    fits = out.where("depth is not null").withColumn("shard", shard)
    return fits, (out.where("depth is null").select(*rows.columns) if n_open else None)


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES, key_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: _key, n_bytes, shard (its bits as text), depth, shard_bytes, shard_docs, and ``_row`` if ``carry``."""
    body = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []), F.col(key_col).alias("_key"), hash_of(F.col(key_col)).alias("_h"), body.alias("_n"))
    fits, rest = _assign(rows, limit, "")
    if rest is not None:
        numbered = cut(rest.withColumn("_number", F.monotonically_increasing_id()), "overflow")
        again = numbered.withColumn("_h", hash_of(F.concat_ws("/", F.coalesce(F.col("_key").cast("string"), F.lit("")), F.col("_number")))).drop("_number")
        more, left = _assign(again, limit, "x")
        if left is not None:
            raise RuntimeError("rows with different numbers share a hash of 60 bits")
        fits = fits.unionByName(more)
    return fits.withColumnRenamed("_n", "n_bytes").drop("_h")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, key_col: str = "doc_id", text_col: str = "text") -> None:
    """A folder ``shard=s<bits>`` for each shard (with underscores before it if ``docs`` has a column of that name); a shard's rows meet in one task, which the limit bounds."""
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    rows = assign_shards(docs, limit, key_col, text_col, carry=True).select(F.concat(F.lit("s"), "shard").alias(name), "_row")
    rows.repartition(F.col(name)).select(name, "_row.*").write.partitionBy(name).parquet(path)
