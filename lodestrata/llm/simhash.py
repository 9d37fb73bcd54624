"""SimHash near-dedup with pigeonring candidate filtering.

A fingerprint is the bitwise majority of the XXH64 hashes of all 4-word shingles of a whole text.  Fingerprints that
differ in at most 4 of 64 bits are linked, and a component is what the links connect.

Candidates.  The 64 bits are a ring of m = 5 segments.  By the pigeonring principle, two fingerprints within 4 bits
have a start segment from which every chain of l consecutive segments has at most floor(4 l / 5) differing bits: none
in the first, one in the first two, two in the first three, and so on.  Two fingerprints that satisfy the first l
conditions agree on some *mask* (the first segment, and the next ones but for the bits that may differ), so they meet
in the bucket (mask, fingerprint & mask).  The masks are chosen by the number of distinct fingerprints so that a
bucket of unrelated fingerprints stays small; every choice finds every link.

Verification.  Inside a bucket, chains of all lengths are checked before the full Hamming distance, and a bucket gives
one link per member (to the least member of its part), never all pairs.  A bucket with more than ``BUCKET`` members
is not brought into one task: its members are linked through the points at distance two or less from both (two
fingerprints within 4 bits always share one, and at most 2,081 fingerprints are near a point).

Defined results: null and empty texts have fingerprint zero and are linked like any other; a text of fewer than four
words has one shingle, its whole word sequence.  A component's id is its smallest doc_id; null ids are passed over.
Repeated ids give repeated rows.  A very long text is shingled whole, held once by its task.  An empty table gives an
empty result.  ``near_dedup`` carries rows as structs, so columns of any name come back as they were; the others return
ids and new columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import connected_components, cut, small, text_batches, text_or_empty

BITS, LIMIT, SEED, SHINGLE = 64, 4, 42, 4
#: Ring segments (first bit, width).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Members up to which a bucket is compared in one task.
BUCKET = 4096
#: Distinct fingerprints up to which the first and the second of the mask sets are used.
FEW, MANY = 1 << 20, 1 << 30


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: lower-cases A-Z only and splits at \x20 and \x09-\x0d only
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
        hash_of, seed = xxhash.xxh64_intdigest, SEED
        hashes = [hash_of(line[a:b], seed) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x) for x in batch.column("_t").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(prints)], ["_id", "fp"])


def _mask(*bits: range | list[int]) -> int:
    return sum(1 << b for part in bits for b in part)


def _segment(i: int) -> list[int]:
    first, width = SEGMENTS[i % len(SEGMENTS)]
    return list(range(first, first + width))


def masks(distinct: int) -> list[int]:
    """The bits on which candidates must agree: chains of two segments by halves or by single bits, or of three."""
    out = []
    for i in range(len(SEGMENTS)):
        a, b, c = _segment(i), _segment(i + 1), _segment(i + 2)
        if distinct <= FEW:  # at most one bit of b differs, so one half of it doesn't
            out += [_mask(a, b[: len(b) // 2]), _mask(a, b[len(b) // 2 :])]
        elif distinct <= MANY:
            out += [_mask(a, [x for x in b if x != y]) for y in b]
        else:  # at most two bits of b and c differ, at most one of them in b
            out += [_mask(a, [x for x in b + c if x not in pair]) for pair in combinations(b + c, 2) if not set(pair) <= set(b)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_SEGMENT_MASKS = [np.uint64(_mask(_segment(i))) for i in range(len(SEGMENTS))]


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which fingerprints are within the limit: a viable chain from some segment first, then the full distance."""
    x = a ^ b
    per = [np.bitwise_count(x & m).astype(np.int64) for m in _SEGMENT_MASKS]
    m, chain = len(per), np.zeros(x.shape, bool)
    for i in range(m):
        good, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int64)
        for step in range(m):
            total = total + per[(i + step) % m]
            good &= total <= (step + 1) * LIMIT // m
        chain |= good
    return chain & (np.bitwise_count(x) <= LIMIT)


def _parts(values: np.ndarray) -> list[tuple[int, int]]:
    """Links from each member to the least member of its connected part."""
    values, links = np.sort(values), []
    left = values
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = linked(left, front.pop())
            found = left[near]
            left = left[~near]
            front += list(found)
            links += [(x, root) for x in found]
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; at most one bucket and one batch are held."""
    held = np.zeros((3, 0), np.int64)

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        m, key, fp = rows[0], rows[1], rows[2].view(np.uint64)
        edge = np.flatnonzero((np.diff(m) != 0) | (np.diff(key) != 0)) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(m)]))
        sizes, links = ends - starts, []
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        near = linked(a, b)
        links += zip(a[near], b[near], strict=True)
        for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            links += _parts(fp[s:e])
        found = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate((held, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("m", "key", "fp")])), axis=1)
        same = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
        first = rows.shape[1] - int(same.sum())
        if first:
            yield solve(rows[:, :first].copy())
        held = rows[:, first:]
    if held.shape[1]:
        yield solve(held.copy())


def _ball() -> list[int]:
    return [0, *(1 << i for i in range(BITS)), *((1 << i) | (1 << j) for i, j in combinations(range(BITS), 2))]


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct values of ``prints.fp`` that have the same components as all links."""
    spark = prints.sparkSession
    text_batches(spark)
    n = prints.count()
    chosen = [_signed(x) for x in masks(n)]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.lit(x) for x in chosen])).alias("m", "mask")).select("m", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    hot = cut(keyed.groupBy("m", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket), "hot")
    n_hot = hot.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cool = keyed.join(small(hot.select("m", "key"), n_hot), ["m", "key"], "left_anti") if n_hot else keyed
    found = cool.repartition(parts, "m", "key").sortWithinPartitions("m", "key").mapInArrow(_bucket_links, "a long, b long")
    if not n_hot:
        return found.distinct()
    members = keyed.join(small(hot.select("m", "key"), n_hot), ["m", "key"], "left_semi").select("fp").distinct()
    points = members.select("fp", F.explode(F.array(*[F.lit(_signed(x)) for x in _ball()])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    stars = points.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("point")).alias("b")).where("a <> b")
    return found.unionByName(stars).distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and fp (the 64 bits as a signed long) of every row."""
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).cast("binary").alias("_t")).mapInArrow(_fingerprints, "_id long, fp long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: _id, fp, component_id."""
    rows = cut(fingerprints(docs, id_col, text_col), "prints")
    distinct = cut(rows.groupBy("fp").agg(F.min("_id").alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp"), bucket))
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    table = cut(roots.join(named, "root").select("fp", "component_id"), "components")
    return rows.join(table, "fp", "left").select("_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every component the row with the smallest id stays (of rows that repeat that id, all: they can't be told apart); rows without an id stay."""
    found = components(docs, id_col, text_col).where("_id is not null")
    gone = cut(found.groupBy("_id").agg(F.bool_or(F.col("_id") == F.col("component_id")).alias("stays")).where("not stays").select("_id"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    return rows.join(small(gone, gone.count()), "_id", "left_anti").select("_row.*")
