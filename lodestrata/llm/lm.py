"""LM scoring with a hierarchical Pitman-Yor model.

The root restaurant serves words; every word has a restaurant for the words that follow it (the end token one for first
words), whose tables are customers of the root.  The base measure gives ``UNKNOWN`` of its mass to one type for all
words outside the training rows and the rest to the known types alike.  Seats are sampled by blocked Gibbs sweeps: all
customers of a word in a restaurant get up and are seated again one after the other (at a table of the word, or at a
new one in proportion to the parent's predictive probability) given everybody else's seats; beyond ``SINGLY``
customers, in runs of up to a 64th of those seated.  A word's probability is the average over the kept samples of the
predictive probability.

Where it runs.  Counts of all training tokens are summed in Spark.  The ``hot_words`` most frequent words (a fixed
number) have a number, the others a 61-bit hash (two of 10^8 words have the same with a chance of 2e-3).  Pairs of the
``DENSE`` most frequent contexts and a hot word make a dense matrix, which the driver samples.  All other pairs are
dealt to lots, with their occurrences in packed arrays: a pair with a rare word by its word, one of a rare context and
a hot word by its context, one of a hot context and a hot word by both.  So a list of one key is at most N / hot_words
occurrences long, or, for a pair of hot words, N / (DENSE + 1).  A lot samples its seats over and over given the totals
of the hot contexts and words, which are summed and sent out again once after the burn-in; of a rare context a lot sees
only its own tables meanwhile.  Then the totals of every rare context are summed over the lots that have a part of it,
so that the predictive probabilities rest on whole totals.

Defined results: a null or empty text has the end token only.  Rows that repeat an id are scored each on its own.  With
no training rows every token is unknown: the base score is that of N = V = 0, the score that of the base measure.
A very long text is read whole, as one row.  An empty table gives an empty result.  Further columns are not returned,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, drop, fold_bucket, setting, text_batches, text_or_empty

END = b"\n"
HOT, DENSE, UNKNOWN, PSEUDO = 32_768, 63, 0.5, 0.1
BURN_IN, SAMPLES, SINGLY, STRENGTH, SEED = 4, 3, 256, 1.0, 29
#: Training tokens for a lot of each kind, occurrences and documents that a task handles at once, words that it counts before it hands them on.
LOT, TOGETHER, COUNTED = 1_000_000, 2_000_000, 1_000_000
#: Documents whose sums are sent together.
BLOCK_BITS = 12
#: How the pairs of a lot are dealt.
BY_WORD, BY_CONTEXT, BY_PAIR = 0, 1, 2
_ROOMS = DENSE + 1  # room 0: the root itself; room i + 1: what follows hot word i
_SLICES = 8
_ZSTD = pa.Codec("zstd", compression_level=1)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]  # of bytes: lower-cases A-Z only and splits at \x20 and \x09-\x0d only


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each cell after its customers were seated one by one; weight: (strength + discount * tables of the restaurant) * parent's probability."""
    order = np.argsort(-customers, kind="stable")
    c, a = customers[order], weight[order]
    t = (c > 0).astype(np.float64)
    negative, i = -c, 1
    while True:
        k = int(np.searchsorted(negative, -i, side="left"))  # the cells with more than i customers
        if not k:
            break
        new = a[:k] / (a[:k] + i - discount * t[:k])
        if i < SINGLY:
            t[:k] += rng.random(k) < new
            i += 1
        else:
            run = max(1, i // 64)
            t[:k] += rng.binomial(np.minimum(run, c[:k] - i), new)
            i += run
    out = np.empty(len(c), np.int64)
    out[order] = t.astype(np.int64)
    return out


class Facts(NamedTuple):
    """Of the training tokens."""

    n: int
    v: int
    root_discount: float
    room_discount: float
    hot: list[bytes]  # most frequent first
    hot_counts: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + PSEUDO) / (self.n + PSEUDO * (self.v + 1)))

    def measure(self, c: np.ndarray) -> np.ndarray:
        """The base measure: of a known type, or of all that is unknown."""
        return np.where(c > 0, (1 - UNKNOWN) / max(1, self.v), UNKNOWN if self.v else 1.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column("_t").to_pylist():
            counts.update(tokens(text))
        if len(counts) > COUNTED:
            yield out()
            counts.clear()
    if counts:
        yield out()


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def _planes(x: np.ndarray) -> bytes:
    """Byte planes without the empty ones, compressed; how many, and of how many integers, comes first."""
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + len(x).to_bytes(8, "little") + _ZSTD.compress(x.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes(), asbytes=True)


def _unplaned(blob: bytes) -> np.ndarray:
    n, size = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((size, 8), np.uint8)
    if size:
        out[:, :n] = np.frombuffer(_ZSTD.decompress(blob[9:], n * size), np.uint8).reshape(n, size).T
    return out.view("<i8").ravel()


def _pack(x: np.ndarray) -> bytes:
    """Integers from 0 on; large ones that repeat as a list of values and places in it."""
    x = np.ascontiguousarray(x, "<i8")
    if x.max(initial=0) >> 32:
        values, back = np.unique(x, return_inverse=True)
        if 4 * len(values) < 3 * len(x):
            head = _planes(values)
            return len(head).to_bytes(8, "little") + head + _planes(back.astype("<i8"))
    return bytes(8) + _planes(x)


def _unpack(blob: bytes) -> np.ndarray:
    head = int.from_bytes(blob[:8], "little")
    rest = _unplaned(blob[8 + head :])
    return _unplaned(blob[8 : 8 + head])[rest] if head else rest


def _codes(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    """Numbers of the hot words, hashes above them of the others."""
    codes = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
    rare = np.flatnonzero(codes < 0)
    if len(rare):
        own = np.empty(len(rare), object)
        own[:] = [words[i] for i in rare.tolist()]
        codes[rare] = (pd.util.hash_array(own, categorize=False) >> np.uint64(3)).astype(np.int64) | 1 << 61
    return codes


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(lengths * data.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


_DOC = {"key": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "hot_known": pa.int64(), "hot_base": pa.float64(), "hot": pa.binary(), "rooms": pa.binary()}
_DEALT = {"lot": pa.int32(), "first": pa.int64(), "u": pa.binary(), "w": pa.binary(), "at": pa.binary()}
_CODED = "key long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_base double, hot binary, rooms binary, lot int, first long, u binary, w binary, at binary"


def _either(schema: dict, values: dict) -> pa.RecordBatch:
    """Rows of a table of two kinds of rows: the other kind's columns are null."""
    n = len(next(iter(values.values())))
    return pa.RecordBatch.from_arrays([pa.array(values[k], t) if k in values else pa.nulls(n, t) for k, t in schema.items()], list(schema))


def _encode(spread, lots: int):
    """A row for each document with its dense pairs, and rows of lots with the other occurrences: context, word, steps of document * 2 + held-out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, bases = spread.value
        h, end, key = len(known), int(_codes([END], index)[0]), TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, ...]] = []
        first, size = key, 0

        def dealt() -> Iterator[pa.RecordBatch]:
            u, w, at = (np.concatenate(x) for x in zip(*held, strict=True))
            lot = np.where(w >= h, w % lots, np.where(u >= h, lots + u % lots, 2 * lots + ((u * h + w) * 0x9E3779B1 >> 16) % lots))
            order = np.argsort(lot.astype(np.uint16 if 3 * lots < 1 << 16 else np.int32), kind="stable")
            lot, u, w, at = lot[order], u[order], w[order], at[order]
            starts = np.flatnonzero(np.diff(lot, prepend=-1))
            ends = np.append(starts[1:], len(lot))
            for i in range(0, len(starts), 1024):
                parts = [slice(a, b) for a, b in zip(starts[i : i + 1024], ends[i : i + 1024], strict=True)]
                yield _either(_DOC | _DEALT, {"lot": lot[starts[i : i + 1024]], "first": [first] * len(parts), "u": [_pack(u[x]) for x in parts], "w": [_pack(w[x]) for x in parts], "at": [_pack(np.diff(at[x], prepend=0)) for x in parts]})

        for batch in batches:
            n, words, lengths = batch.num_rows, [], []
            if not n:
                continue
            for text in batch.column("_t").to_pylist():
                own = tokens(text)
                words += own
                lengths.append(len(own))
            w, lengths = _codes(words, index), np.array(lengths)
            words.clear()
            doc = np.repeat(np.arange(n), lengths)
            u = np.concatenate(([end], w[:-1]))
            u[np.cumsum(lengths)[:-1]] = end
            hot = w < h
            dense = hot & (u < DENSE)
            rest, in_doc = ~dense, np.bincount(doc[dense], minlength=n)
            sums = [np.bincount(doc[hot], x[w[hot]], n) for x in (known, bases)]
            yield _either(_DOC | _DEALT, {"key": np.arange(key, key + n), "doc_id": batch.column("_id"), "held_out": batch.column("held_out"), "n_tokens": lengths, "hot_known": sums[0].astype(np.int64), "hot_base": sums[1], "hot": _binary(w[dense].astype("<u2"), in_doc), "rooms": _binary((u[dense] + 1).astype(np.uint8), in_doc)})
            out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((u[rest], w[rest], (key - first + doc[rest]) * 2 + out[doc[rest]]))
            size += len(held[-1][0])
            key += n
            if size >= TOGETHER:
                yield from dealt()
                held.clear()
                first, size = key, 0
        if size:
            yield from dealt()

    return run


def _pair_counts(width: int):
    """Of the task: (room * width + word, n), summed densely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_ROOMS * width, np.int64)
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column("hot").to_pylist()), "<u2").astype(np.int64)
            rooms = np.frombuffer(b"".join(batch.column("rooms").to_pylist()), np.uint8).astype(np.int64)
            for at in range(0, len(words), 1 << 21):
                pair, n = np.unique(rooms[at : at + (1 << 21)] * width + words[at : at + (1 << 21)], return_counts=True)
                sums[pair] += n
        cell = np.flatnonzero(sums)
        for at in range(0, len(cell), 1 << 16):
            part = cell[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], ["cell", "n"])

    return run


class Lot(NamedTuple):
    """Pairs of words: codes of the contexts and words, which of them a pair has, its training count and its occurrences."""

    number: int
    kind: int
    contexts: np.ndarray
    words: np.ndarray
    context: np.ndarray
    word: np.ndarray
    c: np.ndarray


_ARRAYS = ("contexts", "words", "context", "word", "c")
_LOT = "lot int, kind int, contexts binary, words binary, context binary, word binary, c binary, seen binary, keys binary"


def _build(lots: int):
    """From rows sorted by lot, a row for each lot: its pairs, how often each is seen, and the keys of the documents in the order of the pairs."""

    def lot(number: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        u, w, at = (np.concatenate(x) for x in zip(*held, strict=True))
        contexts, context = np.unique(u, return_inverse=True)
        words, word = np.unique(w, return_inverse=True)
        pair = word * len(contexts) + context
        order = np.argsort(pair)
        pair, at = pair[order], at[order]
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        c = np.add.reduceat(1 - (at & 1), starts)
        arrays = (contexts, words, pair[starts] % len(contexts), pair[starts] // len(contexts), c, np.diff(np.append(starts, len(pair))), at >> 1)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([number // lots], pa.int32()), *(pa.array([_pack(x)], pa.binary()) for x in arrays)], ["lot", "kind", *_ARRAYS, "seen", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            for n, first, u, w, at in zip(*(batch.column(x).to_pylist() for x in ("lot", "first", "u", "w", "at")), strict=True):
                if held and n != number:
                    yield lot(number, held)
                    held.clear()
                number = n
                held.append((_unpack(u), _unpack(w), _unpack(at).cumsum() + 2 * first))
        if held:
            yield lot(number, held)

    return run


def _lots(batch: pa.RecordBatch) -> Iterator[tuple[int, Lot]]:
    for i in range(batch.num_rows):
        number, kind, *arrays = (batch.column(x)[i].as_py() for x in ("lot", "kind", *_ARRAYS))
        yield i, Lot(number, kind, *map(_unpack, arrays))


def _tables(lot: Lot, t: np.ndarray, totals: np.ndarray, hot: int) -> np.ndarray:
    """Tables of each context's restaurant: all of a hot context's, the lot's own of a rare one's."""
    own = np.bincount(lot.context, t, len(lot.contexts))
    there = lot.contexts < hot
    own[there] = totals[lot.contexts[there] + 1]
    return own


def seats(lot: Lot, m: Chances, sweeps: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``keep`` states of the lot, of the start and ``sweeps`` sweeps: tables of each pair and, of a lot by word, tables at the root."""
    rng, s, hot = np.random.default_rng((SEED, lot.number)), m.samples[0], len(m.facts.hot_counts)
    by_word, many = lot.kind == BY_WORD, np.flatnonzero(lot.c > 1)
    t, up = (lot.c > 0).astype(np.int64), np.zeros(len(lot.words), np.int64)
    if by_word:
        base = m.facts.measure(np.bincount(lot.word, lot.c, len(lot.words)))
        customers = np.bincount(lot.word, t, len(lot.words)).astype(np.int64)
        up = (customers > 0).astype(np.int64)
    lower, upper = [t], [up]
    for _ in range(sweeps):
        parent = m.root(s, customers, up, base) if by_word else s.parent[lot.words]
        tables = _tables(lot, t, s.room_tables, hot)
        t = t.copy()
        t[many] = seat(lot.c[many], (STRENGTH + m.facts.room_discount * tables[lot.context[many]]) * parent[lot.word[many]], m.facts.room_discount, rng)
        if by_word:
            customers = np.bincount(lot.word, t, len(lot.words)).astype(np.int64)
            up = seat(customers, (STRENGTH + m.facts.root_discount * s.root_tables) * base, m.facts.root_discount, rng)
        lower, upper = [*lower, t][-keep:], [*upper, up][-keep:]
    return np.array(lower), np.array(upper)


_PART = {"u": pa.int64(), "lot": pa.int32(), "c": pa.int64(), **{f"t{s}": pa.int64() for s in range(SAMPLES)}}
_TOTAL = {"slice": pa.int32(), "sums": pa.binary()}
_SEATED = "u long, lot int, c long, " + "".join(f"t{s} long, " for s in range(SAMPLES)) + "slice int, sums binary"


def _cells(rooms: int, hot: int) -> int:
    """Cells of a sample's totals: root customers of rare words, tables of each hot context, root customers of each hot word, root tables of rare words."""
    return rooms + hot + 1


def _sampler(spread, sweeps: int, keep: int, parts: bool):
    """The task's totals for each kept state and its pairs seen once and twice in training; with ``parts``, a row for each rare context of a lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Chances = spread.value
        hot, rooms = len(m.facts.hot_counts), len(m.room_customers)
        sums, few = np.zeros((keep, _cells(rooms, hot)), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for _, lot in _lots(batch):
                lower, upper = seats(lot, m, sweeps, keep)
                few += [(lot.c == 1).sum(), (lot.c == 2).sum()]
                there = lot.contexts < hot
                tables = [np.bincount(lot.context, t, len(lot.contexts)).astype(np.int64) for t in lower]
                for s in range(keep):
                    sums[s, lot.contexts[there] + 1] += tables[s][there]
                    if lot.kind == BY_WORD:
                        sums[s, 0] += lower[s].sum()
                        sums[s, -1] += upper[s].sum()
                    else:
                        sums[s, rooms + lot.words] += np.bincount(lot.word, lower[s], len(lot.words)).astype(np.int64)
                if parts and not there.all():
                    own = np.bincount(lot.context, lot.c, len(lot.contexts)).astype(np.int64)
                    yield _either(_PART | _TOTAL, {"u": lot.contexts[~there], "lot": np.full((~there).sum(), lot.number), "c": own[~there], **{f"t{s}": x[~there] for s, x in enumerate(tables)}})
        pieces = np.array_split(np.append(sums.ravel(), few), _SLICES)
        yield _either(_PART | _TOTAL, {"slice": np.arange(_SLICES), "sums": [_pack(x) for x in pieces]})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, blob in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            sums[number] = sums.get(number, 0) + _unpack(blob)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_pack(x) for x in sums.values()], pa.binary())], ["slice", "sums"])


def _summed(seated: DataFrame, keep: int) -> tuple[np.ndarray, np.ndarray]:
    rows = seated.where("slice is not null").select("slice", "sums").repartition(_SLICES, "slice").mapInArrow(_add, "slice int, sums binary").collect()
    flat = np.concatenate([_unpack(bytes(r["sums"])) for r in sorted(rows)])
    return flat[:-2].reshape(keep, -1), flat[-2:]


class Sample(NamedTuple):
    """Totals of one state of the seats: customers and tables of the root, tables of each room, probabilities of the hot words at the root."""

    root_customers: int
    root_tables: int
    room_tables: np.ndarray
    parent: np.ndarray | None = None


class Chances(NamedTuple):
    facts: Facts
    room_customers: np.ndarray
    samples: list[Sample]

    def root(self, s: Sample, customers, tables, base):
        d = self.facts.root_discount
        return (customers - d * tables + (STRENGTH + d * s.root_tables) * base) / (STRENGTH + s.root_customers)

    def follow(self, customers, tables, all_customers, all_tables, parent):
        d = self.facts.room_discount
        return (customers - d * tables + (STRENGTH + d * all_tables) * parent) / (STRENGTH + all_customers)

    def room(self, s: Sample, room, customers, tables, parent):
        return self.follow(customers, tables, self.room_customers[room], s.room_tables[room], parent)


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, *values = (np.concatenate(x) for x in zip(*held, strict=True))
    keys, back = np.unique(keys, return_inverse=True)
    return (keys, *(np.bincount(back, x, len(keys)) for x in values))


def _lot_scorer(spread):
    """For the task's documents, sums over the occurrences in its lots, whose seats are sampled as before; ``told``: whole totals of contexts that more lots have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, m = spread.value
        hot, held, size = len(m.facts.hot_counts), [], 0

        def out() -> pa.RecordBatch:
            keys, known, bases, logs = held[0]
            blocks = keys >> BLOCK_BITS
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            parts = [slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)]
            columns = ([_pack(keys[x] & (1 << BLOCK_BITS) - 1) for x in parts], [_pack(known[x].astype(np.int64)) for x in parts], [bases[x].tobytes() for x in parts], [logs[x].tobytes() for x in parts])
            return pa.RecordBatch.from_arrays([pa.array(blocks[starts]), *(pa.array(x, pa.binary()) for x in columns)], ["block", "docs", "known", "bases", "logs"])

        for batch in batches:
            for i, lot in _lots(batch):
                lower, upper = seats(lot, start, BURN_IN + SAMPLES, SAMPLES)
                there = lot.contexts < hot
                customers = np.bincount(lot.context, lot.c, len(lot.contexts))
                customers[there] = m.room_customers[lot.contexts[there] + 1]
                told = batch.column("told").slice(i, 1).flatten()
                column = lambda name: told.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                at = np.searchsorted(lot.contexts, column("u"))
                customers[at] = column("c")
                count = np.bincount(lot.word, lot.c, len(lot.words))
                chance = np.zeros(len(lot.c))
                for s, sample in enumerate(m.samples):
                    tables = _tables(lot, lower[s], sample.room_tables, hot)
                    tables[at] = column(f"t{s}")
                    parent = m.root(sample, np.bincount(lot.word, lower[s], len(lot.words)), upper[s], m.facts.measure(count)) if lot.kind == BY_WORD else sample.parent[lot.words]
                    chance += m.follow(lot.c, lower[s], customers[lot.context], tables[lot.context], parent[lot.word])
                seen, keys = _unpack(batch.column("seen")[i].as_py()), _unpack(batch.column("keys")[i].as_py())
                by_word = lot.kind == BY_WORD  # the encoder counts hot words
                values = (((count > 0) & by_word)[lot.word], (m.facts.base(count) * by_word)[lot.word], np.log10(chance / SAMPLES))
                held.append(_merged([(keys, *(np.repeat(x, seen) for x in values))]))
                size += len(held[-1][0])
                if size > TOGETHER:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > TOGETHER // 2:
                        yield out()
                        held, size = [], 0
        if held:
            held = [_merged(held)]
            yield out()

    return run


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a block, from rows sorted by block."""
    block, sums = None, np.zeros((4, 1 << BLOCK_BITS))

    def out() -> pa.RecordBatch:
        docs = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays([pa.array((block << BLOCK_BITS) + docs), pa.array(sums[1, docs].astype(np.int64)), pa.array(sums[2, docs]), pa.array(sums[3, docs])], ["key", "lot_known", "lot_base", "lot_score"])

    for batch in batches:
        for at, docs, known, bases, logs in zip(*(batch.column(x).to_pylist() for x in ("block", "docs", "known", "bases", "logs")), strict=True):
            if at != block:
                if block is not None:
                    yield out()
                block = at
                sums[:] = 0
            docs = _unpack(docs)
            for row, x in zip(sums, (1, _unpack(known), np.frombuffer(bases), np.frombuffer(logs)), strict=True):
                row[docs] += x
    if block is not None:
        yield out()


def sample_hot(facts: Facts, counts: np.ndarray, totals: np.ndarray, other_customers: np.ndarray, dealt: np.ndarray | None = None) -> tuple[Chances, np.ndarray]:
    """Gibbs sweeps over the dense part; the model's totals and log10 chance of each hot word in each dense room.

    Of the lots, for each sample: ``totals`` (root customers of rare words, tables of each room, root tables of rare
    words) and ``dealt``, root customers of each hot word; ``other_customers`` of each room.
    """
    rng = np.random.default_rng(SEED)
    rooms, words = np.nonzero(counts[1:])
    rooms = rooms + 1
    c = counts[rooms, words]
    room_customers = other_customers.copy()
    room_customers[:_ROOMS] += counts.sum(1)
    base = facts.measure(facts.hot_counts)
    low = np.ones(len(c), np.int64)
    direct = [counts[0] + (0 if dealt is None else dealt[s]) for s in range(SAMPLES)]
    root = direct[0] + np.bincount(words, low, counts.shape[1]).astype(np.int64)
    up = (root > 0).astype(np.int64)

    def sample(s: int) -> Sample:
        tables = totals[s, :-1].copy()
        tables[:_ROOMS] += np.bincount(rooms, low, _ROOMS).astype(np.int64)
        return Sample(int(root.sum() + totals[s, 0]), int(up.sum() + totals[s, -1]), tables)

    samples, lows = {}, {}
    for sweep in range(BURN_IN + SAMPLES):
        s = sweep % SAMPLES
        now = sample(s)
        parent = Chances(facts, room_customers, []).root(now, root, up, base)
        low = seat(c, (STRENGTH + facts.room_discount * now.room_tables[rooms]) * parent[words], facts.room_discount, rng)
        root = direct[s] + np.bincount(words, low, counts.shape[1]).astype(np.int64)
        up = seat(root, (STRENGTH + facts.root_discount * now.root_tables) * base, facts.root_discount, rng)
        if sweep >= BURN_IN:
            now = sample(s)
            samples[s], lows[s] = now._replace(parent=Chances(facts, room_customers, []).root(now, root, up, base)), low
    model = Chances(facts, room_customers, [samples[s] for s in range(SAMPLES)])
    logs, edges = np.zeros(counts.shape, np.float32), np.searchsorted(rooms, np.arange(_ROOMS + 1))
    for room in range(_ROOMS):
        chance, own = np.zeros(counts.shape[1]), slice(edges[room], edges[room + 1])
        for s, state in enumerate(model.samples):
            tables = np.zeros(counts.shape[1])
            tables[words[own]] = lows[s][own]
            chance += model.room(state, room, counts[room], tables, state.parent) if room else state.parent
        logs[room] = np.log10(np.maximum(chance / SAMPLES, 1e-300))
    return model, logs


def _hot_scorer(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, rest = spread.value, ["key", "doc_id", "held_out", "n_tokens", "hot_known", "hot_base"]
        for batch in batches:
            out = []
            for hot, rooms in zip(batch.column("hot").to_pylist(), batch.column("rooms").to_pylist(), strict=True):
                w, r = np.frombuffer(hot, "<u2"), np.frombuffer(rooms, np.uint8)
                out.append(float(logs[r, w].sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(out, pa.float64())], [*rest, "hot_score"])

    return run


def score(docs: DataFrame, held_out_of: int = 10, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; held-out: crc32 of the id modulo ``held_out_of`` is 0."""
    spark = docs.sparkSession
    context = spark.sparkContext
    text_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), (fold_bucket(F.col(id_col), held_out_of) == 0).alias("held_out"), text_or_empty(text_col).cast("binary").alias("_t"))
    counts = cut(rows.where("not held_out").select("_t").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n, v, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = counts.orderBy(F.desc("n"), "word").limit(hot_words).collect()
    drop(counts)
    hot, hot_counts = [bytes(r["word"]) for r in top], np.zeros(hot_words, np.int64)
    hot_counts[: len(top)] = [r["n"] for r in top]
    facts = Facts(n, v, _discount(once, twice), 0.5, [], hot_counts)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots = max(parts, n // LOT)
    coded = cut(rows.mapInArrow(_encode(context.broadcast(({w: i for i, w in enumerate(hot)}, hot_counts > 0, facts.base(hot_counts))), lots), _CODED), "coded")
    texts = cut(coded.where("lot is null").select(*_DOC), "texts")
    sums = cut(texts.where("not held_out").select("hot", "rooms").mapInArrow(_pair_counts(hot_words), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "pairs")  # at most _ROOMS * hot_words rows
    flat, share = np.zeros(_ROOMS * hot_words, np.int64), -(-_ROOMS * hot_words // 8)
    for at in range(0, len(flat), share):  # in eighths, for the driver's memory
        part = sums.where((F.col("cell") >= at) & (F.col("cell") < at + share)).toPandas()
        flat[part["cell"].to_numpy()] = part["n"].to_numpy()
    matrix = flat.reshape(_ROOMS, hot_words)

    with setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch="64"):
        built = cut(coded.where("lot is not null").select("lot", "first", "u", "w", "at").repartition(parts, "lot").sortWithinPartitions("lot").mapInArrow(_build(lots), _LOT), "lots")
    drop(coded)
    rooms = max(_ROOMS, hot_words + 1)
    customers = np.zeros(rooms, np.int64)
    customers[1 : hot_words + 1] = hot_counts  # whatever the word, one follows it
    blank = Chances(facts, customers, [Sample(0, 0, np.zeros(rooms, np.int64), np.zeros(hot_words))])
    other = customers - np.pad(matrix.sum(1), (0, rooms - _ROOMS))

    def seated(m: Chances, sweeps: int, keep: int, of_rare: bool) -> DataFrame:
        return cut(built.select("lot", "kind", *_ARRAYS).mapInArrow(_sampler(context.broadcast(m), sweeps, keep, of_rare), _SEATED), "seated")

    def sampled(totals: np.ndarray) -> tuple[Chances, np.ndarray]:
        every = np.broadcast_to(totals, (SAMPLES, totals.shape[1]))
        return sample_hot(facts, matrix, np.concatenate((every[:, :rooms], every[:, -1:]), axis=1), other, every[:, rooms:-1])

    with setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1"):  # of lots
        start = seated(blank, 0, 1, False)
        totals, few = _summed(start, 1)
        facts = facts._replace(room_discount=_discount(int((matrix[1:] == 1).sum() + few[0]), int((matrix[1:] == 2).sum() + few[1])))
        model, _ = sampled(totals)
        burnt = seated(model, BURN_IN, 1, False)
        model, _ = sampled(_summed(burnt, 1)[0])
        last = seated(model, BURN_IN + SAMPLES, SAMPLES, True)
        final, logs = sampled(_summed(last, SAMPLES)[0])
        values = ["c", *(f"t{s}" for s in range(SAMPLES))]
        whole = last.where("slice is null").groupBy("u").agg(*[F.sum(x).alias(x) for x in values], F.collect_list("lot").alias("lots")).where(F.size("lots") > 1)
        told = cut(whole.select("u", *values, F.explode("lots").alias("lot")).groupBy("lot").agg(F.collect_list(F.struct("u", *values)).alias("told")), "told")
        drop(start, burnt, last)
        thin = model._replace(samples=model.samples[:1])
        some = built.where(F.col("kind") != BY_PAIR).join(told, "lot", "left")  # contexts of the others are all hot
        every = some.unionByName(built.where(F.col("kind") == BY_PAIR).withColumn("told", F.lit(None).cast(told.schema["told"].dataType)))
        lot_sums = every.mapInArrow(_lot_scorer(context.broadcast((thin, final))), "block long, docs binary, known binary, bases binary, logs binary")
        lot_sums = lot_sums.repartition(parts, "block").sortWithinPartitions("block")
        lot_sums = cut(lot_sums.mapInArrow(_block_sums, "key long, lot_known long, lot_base double, lot_score double"), "sums")
    drop(sums, built, told)
    hot_sums = texts.select("key", "doc_id", "held_out", "n_tokens", "hot_known", "hot_base", "hot", "rooms").mapInArrow(_hot_scorer(context.broadcast(logs)), "key long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_base double, hot_score double")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    both = hot_sums.join(lot_sums, "key", "left")
    return both.select("doc_id", "held_out", "n_tokens", add("hot_known", "lot_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), add("hot_base", "lot_base").alias("base_score"), add("hot_score", "lot_score").alias("score"))
