"""Benchmark decontamination by template canonicalisation.

Words are reduced to templates: lower case, no outer punctuation, and a typed placeholder for a number, a unit or a
name (a capitalised word inside a sentence).  Windows of template words are joined by hash with those of the benchmark.
Windows of one item that match along one alignment (same distance between the positions) must agree on the slots: each
value of the item stands for one value of the text, and different names for different ones; different quantities may
become equal.  So a question with other numbers or names is caught, and a text that merely has placeholders in the same
places isn't.  Agreement is asked of windows in succession, and the longest such run counts; a window without slots, or
with the item's own values, counts whatever the slots of others say.

A text is contaminated by an item if at least ``RUN`` windows of one alignment match consistently (all of them, if the
item has fewer): 13 words in a row, or as many apart from a change.  A window counts as a template if most of its words
are literal; any other counts as it stands, word for word, unless it has fewer than ``SHORTEST`` different words or is
numbers in even steps (1 2 3 ...).  Scripts without blanks are split by character.

Whether a capitalised word is a name depends on what comes before it.  So alignments are looked for with line breaks
within sentences and with line breaks as their ends, with an item's first word as a literal and as a name, and by the
words as they stand; along an alignment, words agree if they are the same in lower case or have the same placeholder.

The benchmark is read in blocks of bounded size; each block's windows are a table that the tasks hold, and every text
passes every block.

Defined results: null and empty texts and items match nothing; an item of fewer than ``WINDOW`` words is one window of
its own length, and one with fewer than ``SHORTEST`` different words is never matched.  Items or texts that repeat are
treated like any other; of several items the smallest id is named.  A very long text is matched whole.  Without items every text is
clean, and an empty table gives an empty result.  Columns of any name are carried in a struct.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import text_batches, text_or_empty

WINDOW, RUN, SHORTEST = 8, 6, 4
#: Characters of benchmark text in a block.
BLOCK_CHARS = 32_000_000
#: Word forms that a worker remembers.
CACHED_WORDS = 400_000
NUMBER, UNIT, NAME, MEASURE = "<number>", "<unit>", "<name>", "<number><unit>"
QUANTITIES = {NUMBER, UNIT, MEASURE}
#: Fixed list of units.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l dl gal s sec min h hr hrs ms v kv w kw kwh mw hz khz mhz ghz j kj cal kcal n pa kpa bar psi k c f mph kmh kph % $ € £ usd eur gbp meter meters metre metres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split())
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_MEASURE = re.compile(r"([$€£]?)([+-]?\d[\d.,:/]*)([^\W\d]+|%|€|£|\$)?")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_END = re.compile(r"[.!?:][\"')\]]*$")


#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese characters.
_UNSPACED = re.compile("[\u0e01-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17dd\u3005-\u3007\u3041-\u3096\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def template(raw: str) -> tuple[str, bool, bool]:
    """The word's template ('' if it has no letter or digit), whether it is capitalised, whether it ends a sentence."""
    ends = bool(_END.search(raw))
    bare = _EDGES.sub("", raw)
    if not bare:
        return (UNIT if raw in UNITS else ""), False, ends
    low = bare.lower()
    if _NUMBER.fullmatch(bare):
        outer = raw.strip("()[]\"'.,;:!?")
        return (MEASURE if outer[:1] in "$€£" or outer[-1:] in "%$€£" else NUMBER), False, ends
    if (m := _MEASURE.fullmatch(bare)) and m[3] and m[3].lower() in UNITS:
        return MEASURE, False, ends
    if low in UNITS and len(low) > 2:
        return UNIT, False, ends
    return low, bare[:1].isupper() and bare[1:2] != bare[1:2].upper(), ends


def _bare(word: str) -> str:
    return _EDGES.sub("", word).lower() or word


def spaced(text: str) -> str:
    """Of scripts that are written without blanks, every character is a word."""
    return text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)


def line_starts(text: str) -> list[int]:
    """Indices of the words that begin a line."""
    sizes = [len(line.split()) for line in text.splitlines()]
    return [at - n for at, n in zip(accumulate(sizes), sizes, strict=True) if n]


def canonical(text: str, lines: bool = False, fresh: bool = True) -> tuple[list[str], list[str]]:
    """Template words and, beside them, the words that they stand for; whether a line's end ends a sentence and the text begins one."""
    text = spaced(text)
    out, raw, number, starts = [], [], False, set(line_starts(text) if lines else ())
    for i, word in enumerate(text.split()):
        fresh = fresh or i in starts
        t, capital, ends = template(word)
        if t:
            low = _bare(word)
            if capital and not fresh:
                t = NAME
            elif number and low in UNITS:
                t = UNIT
            out.append(t)
            raw.append(low)
            number = t == NUMBER
            fresh = False
        fresh = fresh or ends
    return out, raw


KINDS = (NUMBER, UNIT, NAME, MEASURE)  # the first indices of the words
_SLOTS = set(KINDS)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashes(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window that begins there."""
    x = (ids + 2).astype(np.uint64) * _STEP
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x ^= x >> np.uint64(29)
    h = np.full(len(at), width, np.uint64)
    for k in range(width):
        h = h * _STEP + x[at + k]
    return h ^ (h >> np.uint64(31))


def in_all(flags: np.ndarray, width: int) -> np.ndarray:
    """For every window, how many flags are set in it."""
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[width:] - sums[:-width]


class Windows(NamedTuple):
    words: dict[str, int]  # template words and raw words of the block's items
    keys: np.ndarray  # sorted hashes of windows
    places: np.ndarray  # beside them: index of the item, position
    widths: list[int]
    names: list[int]  # of the items: their ids,
    edges: np.ndarray  # where their words begin,
    templates: np.ndarray  # the words' templates
    raw: np.ndarray  # and the words themselves,
    literal: np.ndarray  # whether the window from there counts as it stands (all zeros behind an item's last window)
    counting: list[tuple[int, int]]  # number of their windows that count as templates, and as templates or as they stand


def _least(width: int) -> int:
    return max(SHORTEST, width // 2 + 1)


def specific(raw: list[str], width: int) -> np.ndarray:
    """Of each window: whether its words are telling as they stand; not few different ones, and not numbers in even steps."""
    out = np.zeros(max(0, len(raw) - width + 1), bool)
    for at in range(len(out)):
        part = raw[at : at + width]
        if len(set(part)) >= SHORTEST:
            steps = {int(b) - int(a) for a, b in zip(part, part[1:], strict=False)} if all(x.isdecimal() and len(x) < 19 for x in part) else set()
            out[at] = len(steps) != 1
    return out


def windows_of(items: list[tuple[int, str | None]], window: int = WINDOW) -> Windows:
    words = {k: i for i, k in enumerate(KINDS)}
    keys, places, widths, counting = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)], set(), []
    edges, templates, raws, literal = [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for i, (_, text) in enumerate(items):
        both = canonical(text or "")
        readings = canonical(text or "", lines=True)[0], canonical(text or "", fresh=False)[0]  # of capitalised words
        t, raw, *others = (np.array([words.setdefault(x, len(words)) for x in xs], np.int64) for xs in (*both, *readings))
        width = min(window, len(t))
        counts = in_all(t >= len(KINDS), width) >= _least(width) if width else np.zeros(0, bool)
        stands = counts | specific(both[1], width) if width else counts
        for ids, of in ((t, counts), (raw, stands), *((x, counts) for x in others)) if width else ():
            at = np.flatnonzero(of & (in_all(ids != t, width) > 0) if ids is not t else of)
            if len(at):
                widths.add(width)
                keys.append(hashes(ids, at, width))
                places.append(np.stack((np.full(len(at), i), at), 1))
        counting.append((int(counts.sum()), int(stands.sum())))
        literal.append(np.concatenate((stands, np.zeros(len(t) - len(stands), bool))))
        edges.append(edges[-1] + len(t))
        templates.append(t)
        raws.append(raw)
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(key, kind="stable")
    return Windows(words, key[order], place[order], sorted(widths), [x for x, _ in items], np.array(edges), np.concatenate(templates), np.concatenate(raws), np.concatenate(literal), counting)


def consistent(pairs: set[tuple]) -> bool:
    """Over (type, value in the item, value in the text): a value stands for one value, and different names for different ones; quantities may coincide."""
    return longest([pairs]) == 1


def longest(parts: list[set[tuple]]) -> int:
    """The most sets of pairs in succession that are consistent together."""
    tables: dict[tuple, Counter] = defaultdict(Counter)
    bad = first = best = 0

    def put(part: set[tuple], step: int) -> int:
        change = 0
        for kind, a, b in part:
            for key, value in (((0, kind, a), b), ((1, kind, b), a)):
                if key[0] and kind in QUANTITIES:
                    continue
                seen = tables[key]
                change -= len(seen) > 1
                seen[value] += step
                if not seen[value]:
                    del seen[value]
                change += len(seen) > 1
        return change

    for last, part in enumerate(parts):
        bad += put(part, 1)
        while bad:
            bad += put(parts[first], -1)
            first += 1
        best = max(best, last + 1 - first)
    return best


class Matcher:
    def __init__(self, windows: Windows, run: int = RUN):
        self.w, self.run, self.forms = windows, run, {}
        bits = max(10, len(windows.keys).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)  # few hashes of a text pass this and need a search
        self.maybe[windows.keys >> self.shift] = True

    def _form(self, raw: str) -> int:
        """Bits: 0 counts as a word, 1 capitalised, 2 ends a sentence, 3 number, 4 the word is a unit's sign; from 5 and from 34: the indices + 1 of template and word, 0 if no item has it."""
        t, capital, ends = template(raw)
        low = _bare(raw)
        return bool(t) | capital << 1 | ends << 2 | (t == NUMBER) << 3 | (low in UNITS) << 4 | (self.w.words.get(t, -1) + 1) << 5 | (self.w.words.get(low, -1) + 1) << 34

    def _seeds(self, ids: np.ndarray, other: np.ndarray | None = None) -> set[tuple[int, int]]:
        """(item, alignment) of all windows that the items have too; of those only that differ from the other reading."""
        found, w = set(), self.w
        unknown, changed = ids < 0, None if other is None else ids != other
        if changed is not None and not changed.any():
            return found
        for width in w.widths:
            if len(ids) < width:
                continue
            fit = in_all(unknown, width) == 0
            at = np.flatnonzero(fit if changed is None else fit & (in_all(changed, width) > 0))
            if not len(at):
                continue
            h = hashes(ids, at, width)
            likely = self.maybe[h >> self.shift]
            at, h = at[likely], h[likely]
            lo, hi = (np.searchsorted(w.keys, h, side) for side in ("left", "right"))
            for s, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                found.update((item, s - p) for item, p in w.places[a:b].tolist())
        return found

    def _matched(self, item: int, shift: int, ids: np.ndarray, own: np.ndarray, word_at) -> int:
        """Windows that match along the alignment, 0 if too few."""
        w = self.w
        lo, hi = int(w.edges[item]), int(w.edges[item + 1])
        width, a, b = min(WINDOW, hi - lo), max(0, -shift), min(hi - lo, len(ids) - shift)
        if b - a < width:
            return 0
        t, raw = w.templates[lo + a : lo + b], w.raw[lo + a : lo + b]
        slot, same = t < len(KINDS), raw == own[a + shift : b + shift]
        agree = same | (t == ids[a + shift : b + shift])
        counts = in_all(~slot, width) >= _least(width)
        hit, as_it_stands = (in_all(agree, width) == width) & counts, (in_all(same, width) == width) & w.literal[lo + a : lo + b - width + 1]
        pairs = {p: (KINDS[t[p]], int(raw[p]), word_at(a + shift + p)) for p in np.flatnonzero(slot & agree).tolist()}
        others = [{pairs[p] for p in range(s, s + width) if p in pairs} for s in np.flatnonzero(hit & ~as_it_stands).tolist()]
        by_template = int((as_it_stands & counts).sum()) + longest(others)
        n = by_template + int((as_it_stands & ~counts).sum())
        templates, all_of_it = w.counting[item]
        return n if n and (n >= min(self.run, all_of_it) or by_template and by_template >= min(self.run, templates)) else 0

    def match(self, text: str) -> tuple[int | None, int]:
        """The smallest id of an item that the text contains, and how many windows of it matched along the best alignment."""
        if not len(self.w.keys):
            return None, 0
        text = spaced(text)
        raw = text.split()
        forms = self.forms
        try:
            codes = np.fromiter(map(forms.__getitem__, raw), np.int64, len(raw))
        except KeyError:
            if len(forms) > CACHED_WORDS:
                forms.clear()
            forms |= {x: self._form(x) for x in set(raw).difference(forms)}
            codes = np.fromiter(map(forms.__getitem__, raw), np.int64, len(raw))
        word = (codes & 1) > 0
        # a sentence is fresh if it has no word yet since the last end
        ended = np.cumsum((codes >> 2) & 1)
        places = np.flatnonzero(word)
        if not len(places):
            return None, 0
        before = ended[places] - ((codes[places] >> 2) & 1)  # sentence ends before the word
        fresh = np.concatenate(([True], before[1:] > before[:-1]))
        codes = codes[places]
        own = (codes >> 34) - 1

        def templates(fresh: np.ndarray) -> np.ndarray:
            name = ((codes & 2) > 0) & ~fresh
            after = np.concatenate(([False], ((codes[:-1] & 8) > 0) & ~name[:-1])) & ((codes & 16) > 0) & ~name
            return np.where(name, KINDS.index(NAME), np.where(after, KINDS.index(UNIT), ((codes >> 5) & (1 << 29) - 1) - 1))

        ids = templates(fresh)
        seeds = self._seeds(ids) | self._seeds(own, ids)
        starts = np.zeros(len(raw) + 1, np.int64)
        starts[line_starts(text)] = 1
        lines = np.cumsum(starts)[places]
        begins = np.concatenate(([True], lines[1:] > lines[:-1]))
        if (begins & ~fresh & ((codes & 2) > 0)).any():
            seeds |= self._seeds(templates(fresh | begins), ids)
        best: tuple[int | None, int] = (None, 0)
        for item, shift in seeds:
            n, name_of = self._matched(item, shift, ids, own, lambda p: _bare(raw[places[p]])), self.w.names[item]
            if n and (best[0] is None or (name_of, -n) < (best[0], -best[1])):
                best = name_of, n
        return best


def _matching(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(spread.value)
        for batch in batches:
            found = []
            for text, item, n in zip(*(batch.column(c).to_pylist() for c in ("_t", "item_id", "matched")), strict=True):
                new, m = matcher.match(text)
                found.append((new, m) if new is not None and (item is None or new < item) else (item, n))
            rest = [n for n in batch.schema.names if n not in ("item_id", "matched")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], [*rest, "item_id", "matched"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """_row (all columns of ``docs``), item_id (null if clean) and the number of its windows that matched."""
    spark = docs.sparkSession
    text_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), text_or_empty(item_text_col).alias("text")).where("item is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_or_empty(text_col).alias("_t"), F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("matched"))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()  # a block: bounded by block_chars
        rows = rows.mapInArrow(_matching(spark.sparkContext.broadcast(windows_of([tuple(r) for r in block]))), T.StructType(rows.schema.fields))
    return rows.drop("_t")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item."""
    return matches(docs, benchmark, text_col).where("item_id is null").select("_row.*")
