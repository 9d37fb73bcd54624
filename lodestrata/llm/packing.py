"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens.  Pieces of one length are interchangeable, so the whole corpus
is packed at once on the histogram of lengths, which has at most ``capacity`` entries whatever the corpus: a branch
and bound around the largest remaining piece enumerates undominated fillings, prunes by the waste that the incumbent
(best-fit) still allows, and uses a filling as often as the histogram lets it.  The plan is a list of patterns with
multiplicities; a piece finds its sequence from its rank among the pieces of its length, and ranks come from counts
per task, not from a sort of the corpus.

Defined results: a null or empty text has the end token only (one piece of one token).  Rows that repeat an id are
packed each on its own.  An empty table gives an empty result.
A very long text is cut into pieces of the full length, the first of them shorter.  Further columns are not returned.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, text_batches, text_or_empty

CAPACITY = 2048
#: Nodes of the branch and bound, and of one search for fillings; beyond them the incumbent stands.
NODES, FILL_NODES, FILLINGS = 20_000, 4_000, 4
#: Texts that are encoded together.
TOGETHER = 64


def fillings(sizes: list[int], counts: dict[int, int], room: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from the available sizes (descending), least waste first.

    A filling that some available size still fits into is dominated by the one with that size added, and every filling
    is dominated by a single piece of exactly ``room``.
    """
    if room <= 0 or not sizes or sizes[-1] > room:
        return [()]
    if counts.get(room, 0):
        return [(room,)]
    found: list[tuple[int, tuple[int, ...]]] = []
    left, nodes = dict(counts), 0

    def down(at: int, room: int, taken: tuple[int, ...]) -> bool:
        """True once enough perfect fillings are known or the nodes are used up."""
        nonlocal nodes
        nodes += 1
        if room and left.get(room, 0):
            found.append((0, (*taken, room)))
            return sum(not w for w, _ in found) >= most
        extended = False
        for i in range(at, len(sizes)):
            s = sizes[i]
            if s > room or not left.get(s, 0):
                continue
            extended = True
            if len(taken) >= 12 and i < len(sizes) - 1 and nodes > FILL_NODES // 2:
                continue
            left[s] -= 1
            stop = down(i, room - s, (*taken, s))
            left[s] += 1
            if stop or nodes > FILL_NODES:
                return True
        if not extended:
            found.append((room, taken))
        return False

    down(next(i for i, s in enumerate(sizes) if s <= room), room, ())
    if not found:
        return [best_fit(sizes, counts, room)]
    unique = sorted(set(found), key=lambda x: (x[0], len(x[1])))
    return [f for _, f in unique[:most]]


def best_fit(sizes: list[int], counts: dict[int, int], room: int) -> tuple[int, ...]:
    """Again and again the largest piece that still fits."""
    taken = []
    for s in sizes:
        while s <= room and counts.get(s, 0) > taken.count(s):
            taken.append(s)
            room -= s
    return tuple(taken)


def _times(pattern: tuple[int, ...], counts: dict[int, int]) -> int:
    return min(counts[s] // pattern.count(s) for s in set(pattern))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, times) that use up the histogram in as few bins as were found; stops at the bound ceil(total / capacity)."""
    histogram = {s: n for s, n in histogram.items() if n}
    total = sum(s * n for s, n in histogram.items())
    least = max(-(-total // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))

    incumbent, counts = [], dict(histogram)
    sizes = sorted(counts, reverse=True)
    while sizes:
        counts[sizes[0]] -= 1
        pattern = (sizes[0], *best_fit(sizes, counts, capacity - sizes[0]))
        counts[sizes[0]] += 1
        n = _times(pattern, counts)
        incumbent.append((pattern, n))
        for s in pattern:
            counts[s] -= n
        sizes = [s for s in sizes if counts[s]]
    best = sum(n for _, n in incumbent)

    counts, path, bins, waste, used = dict(histogram), [], 0, 0, 0
    stack: list[list] = []  # of the open choices at each depth
    while best > least and used < nodes:
        sizes = sorted((s for s, n in counts.items() if n), reverse=True)
        if not sizes:
            if bins < best:
                incumbent, best = list(path), bins
            choices: list = []
        elif bins + -(-sum(s * counts[s] for s in sizes) // capacity) >= best or waste > (best - 1) * capacity - total:
            choices = []
        else:
            counts[sizes[0]] -= 1
            choices = [(sizes[0], *f) for f in reversed(fillings([s for s in sizes if counts[s]], counts, capacity - sizes[0]))]
            counts[sizes[0]] += 1
        used += 1
        stack.append(choices)
        while stack and not stack[-1]:
            stack.pop()
            if path:
                pattern, n = path.pop()
                for s in pattern:
                    counts[s] += n
                bins, waste = bins - n, waste - n * (capacity - sum(pattern))
        if not stack:
            break
        pattern = stack[-1].pop()
        n = _times(pattern, counts)
        for s in pattern:
            counts[s] -= n
        path.append((pattern, n))
        bins, waste = bins + n, waste + n * (capacity - sum(pattern))
    return incumbent


def byte_of_character() -> dict[str, int]:
    """Byte-level BPE writes bytes as characters: the visible ones of Latin-1 as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids as little-endian bytes.

    The vocabulary is that of the tokenizer's file.  Its ids follow the order of the merges, which is all that the
    faster engine needs; texts that hold a special token's string go through the tokenizer itself.
    """

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special, code = sorted(added), byte_of_character()
        ranks = {bytes(code[c] for c in word): i for word, i in self.tokenizer.get_vocab().items() if word not in added}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def reference(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        fast, nothing = self.fast.encode_to_numpy, frozenset()
        return [self.reference([x])[0] if any(s in x for s in self.special) else fast(x, allowed_special=nothing, disallowed_special=()).astype("<u4").tobytes() for x in texts]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> Encoder:
    """A worker process serves many tasks; they share what it remembers."""
    return Encoder(path, pattern)


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    first = (tokens - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, tokens, capacity))]


def _piece_maker(path: str, pattern: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(path, pattern), np.zeros(capacity + 1, np.int64)
        task, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column("_id").to_pylist()
            for at in range(0, batch.num_rows, TOGETHER):
                for doc, body in zip(ids[at : at + TOGETHER], encoder.encode(batch.column("_t").slice(at, TOGETHER).to_pylist()), strict=True):
                    body += end
                    for k, (start, length) in enumerate(cuts(len(body) // 4, capacity)):
                        part = body[4 * start : 4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(part), task, int(seen[length]), *([part] if with_ids else [])))
                        seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (task, local): the how-manieth piece of its length in its task."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_t"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long" + ", ids binary" * with_ids
    return rows.mapInArrow(_piece_maker(tokenizer_path, pattern, capacity, end_id, with_ids), schema)


def _assigner(patterns: list[tuple[tuple[int, ...], int]], capacity: int):
    """Where the piece of a length and rank goes: for each length, the ranks at which its slots of the plan begin."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    reached: dict[int, int] = {}
    base = 0
    for pattern, n in patterns:
        offset = 0
        for s in pattern:
            slots.setdefault(s, []).append((reached.get(s, 0), base, offset))
            reached[s] = reached.get(s, 0) + n
            offset += s
        base += n
    tables = {s: np.array(x, np.int64).T for s, x in slots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                own = length == s
                first, where, at = tables[int(s)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = where[k] + rank[own] - first[k], at[k]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids, if wanted)."""
    made = cut(pieces(docs, tokenizer_path, pattern, capacity, end_id, id_col, text_col, with_ids), "pieces")
    tally = cut(made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "tally")
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = made.join(offsets, ["task", "length"]).withColumn("rank", F.col("local") + F.col("ahead"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*columns, "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assigner(plan(histogram, capacity), capacity), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids as little-endian bytes, from ``pack(..., with_ids=True)``; a sequence is at most `capacity` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
