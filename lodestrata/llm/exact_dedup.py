"""Exact dedup by distributed MSD radix partitioning.

Texts are split by their leading bytes, then every bucket that is still too large by the bytes that follow, and so
on.  The split runs in two places:

* over the cluster, on counts only: a pass counts the rows of each prefix and keeps the *oversized* ones; the next
  pass looks only at texts below an oversized prefix and takes a longer prefix.  An oversized prefix that is itself a
  whole text is a finished group: its size and its largest id are already known from the (map-side combined) counts,
  so its rows are never brought together.
* inside a task, on the rows of the buckets that fit: successive byte blocks split a bucket until its parts are
  singletons or have ended.

Two texts are equal iff they stay together to their end; no digest decides.

Defined results: a null text counts as empty.  Rows that repeat the same id and text are copies like any other:
exactly one of them stays.  A null id ranks below all ids.  An empty table gives an empty result.
A very long text is compared by prefixes that grow up to its length.  Columns of any name are carried in a struct.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import cut, small, text_batches

#: First prefix in bytes; each level multiplies it.
FIRST_WIDTH, WIDER = 8, 8
#: A bucket is split on while it has more rows or bytes than this; what fits is held by one task.
BUCKET_ROWS, BUCKET_BYTES = 512, 32 << 20


def radix_groups(texts: list[bytes], start: int = 0, width: int = 16) -> list[list[int]]:
    """Indices of equal texts together: split by successive blocks of bytes (each twice as wide) until singleton or ended."""
    done, stack = [], [(list(range(len(texts))), start, width)]
    while stack:
        rows, at, w = stack.pop()
        if len(rows) == 1:
            done.append(rows)
            continue
        parts = defaultdict(list)
        for i in rows:
            parts[texts[i][at : at + w]].append(i)
        for block, part in parts.items():
            if len(block) < w:  # the texts of this part ended here
                done.append(part)
            else:
                stack.append((part, at + w, 2 * w))
    return done


def _solve(table: pa.Table) -> pa.Table:
    """Adds keep_id, group_size and kept to whole buckets."""
    texts, ids = table.column("_t").to_pylist(), table.column("_id").to_pylist()
    buckets = defaultdict(list)
    for i, key in enumerate(table.column("_bucket").to_pylist()):
        buckets[key].append(i)
    n = len(texts)
    keep, size, kept = ids[:], [1] * n, [True] * n
    for rows in buckets.values():
        if len(rows) == 1:
            continue
        for group in radix_groups([texts[i] for i in rows]):
            if len(group) > 1:
                own = [rows[j] for j in group]
                best = max(own, key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0))
                for i in own:
                    keep[i], size[i], kept[i] = ids[best], len(own), i == best
    out = table.drop_columns(["_bucket", "_t"])
    for name, values, kind in (("keep_id", keep, pa.int64()), ("group_size", size, pa.int64()), ("kept", kept, pa.bool_())):
        out = out.append_column(name, pa.array(values, kind))
    return out


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; at most one bucket and one batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("_bucket")
        last, first = keys[batch.num_rows - 1], 0
        if keys[0].equals(last) and held:
            old = held[-1].column("_bucket")
            if old[len(old) - 1].equals(last):
                held.append(batch)
                continue
        first = batch.num_rows
        while first and keys[first - 1].equals(last):
            first -= 1
        whole = held + ([batch.slice(0, first)] if first else [])
        if whole:
            yield from _solve(pa.Table.from_batches(whole)).to_batches()
        held = [batch.slice(first)]
    if held:
        yield from _solve(pa.Table.from_batches(held)).to_batches()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: _id, keep_id, group_size, kept, text_sha256, and ``_row`` (all columns) if ``carry``."""
    spark = docs.sparkSession
    text_batches(spark)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    src = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []), F.col(id_col).cast("long").alias("_id"), body.alias("_t"))
    prefix = lambda w: F.substring("_t", 1, w)

    levels, width, below = [], FIRST_WIDTH, src.select("_id", "_t")
    while True:
        counts = below.groupBy(prefix(width).alias("_p"), (F.length("_t") <= width).alias("_ended")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("_t")).alias("_b"), F.max("_id").alias("_top"))
        over = cut(counts.where((F.col("_n") > bucket_rows) | ((F.col("_b") > bucket_bytes) & (F.col("_n") > 1))), "radix")
        n_over, n_open = over.agg(F.count(F.lit(1)), F.count_if(~F.col("_ended"))).first()
        if n_over:
            levels.append((width, small(over, n_over, width)))
        if not n_open:
            break
        opened = over.where("not _ended").select("_p")
        below = below.withColumn("_p", prefix(width)).join(small(opened, n_open, width), "_p", "left_semi").where(F.length("_t") > width).select("_id", "_t")
        width *= WIDER

    rows = src.withColumn("text_sha256", F.sha2("_t", 256))
    bucket, top, size = prefix(FIRST_WIDTH), F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, (w, over) in enumerate(levels):
        named = over.select(F.col("_p").alias(f"_p{k}"), F.col("_ended").alias(f"_e{k}"), F.col("_n").alias(f"_n{k}"), F.col("_top").alias(f"_top{k}"))
        rows = rows.withColumn(f"_w{k}", prefix(w)).withColumn(f"_x{k}", F.length("_t") <= w)
        rows = rows.join(named, (F.col(f"_w{k}") == F.col(f"_p{k}")) & (F.col(f"_x{k}") == F.col(f"_e{k}")), "left")
        ended = F.col(f"_e{k}")
        top = F.when(ended, F.col(f"_top{k}")).otherwise(top)
        size = F.when(ended, F.col(f"_n{k}")).otherwise(size)
        bucket = F.when(F.col(f"_e{k}") == False, prefix(w * WIDER)).otherwise(bucket)  # noqa: E712
    keep = [*(["_row"] if carry else []), "_id", "text_sha256"]
    rows = rows.select(*keep, "_t", bucket.alias("_bucket"), top.alias("keep_id"), size.alias("group_size"))

    fits = rows.where("group_size is null").select(*keep, "_t", "_bucket")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = fits.repartition(parts, "_bucket").sortWithinPartitions("_bucket")
    found = [T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField("kept", T.BooleanType())]
    solved = dealt.mapInArrow(_in_task, T.StructType([*fits.select(*keep).schema.fields, *found]))
    if not levels:
        return solved
    whole = rows.where("group_size is not null").select(*keep, "_t", "keep_id", "group_size")
    best = F.col("_id").eqNullSafe(F.col("keep_id"))
    once = F.row_number().over(Window.partitionBy("_t", "_id").orderBy(F.lit(1))) == 1  # only the rows that hold a group's largest id
    return solved.unionByName(whole.where(~best).drop("_t").withColumn("kept", F.lit(False))).unionByName(whole.where(best).withColumn("kept", once).drop("_t"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``."""
    return exact_groups(docs, id_col, text_col, carry=True).where("kept").select("_row.*")
