"""Language ID by language-bitmask n-gram filters.

Training counts the character trigrams of every language over all training rows.  A trigram is *contained* in a
language if it makes up a fair share there of what it makes up in the language that uses it most (so that a stray
foreign passage doesn't put its trigrams into every language).  Contained trigrams go into one Bloom filter per
language; the filters are bit-sliced: cell p holds one word whose bit i says that filter i has bit p set, so the AND of
the k cells of a trigram is the mask of all languages that contain it.  A text's hits per language are the popcounts of
its trigrams' masks, corrected for the filter's false-positive rate, and the largest count decides.

The counts are summed in Spark; the driver gets the cells of the filters only, at most ``MAX_CELLS``.  Where a language
contains too many trigrams for filters of that size, there are no filters: the contained trigrams stay a table, and the
texts' trigrams are joined to it, which gives the same hits without false positives.

Defined results: ``und`` with score 0 if the text is null or has no letters, or if there was nothing to learn from.
The score is the winner's share of all languages' corrected hits.  Ties go to the language with more training
trigrams, then by name.  Rows without a language, and held-out rows, teach nothing.
A very long text is read whole; rows that repeat are treated alike.  An empty table gives an empty result.  Columns of
any name are carried in a struct.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import cut, fold_bucket, text_batches, text_or_empty

#: Hash functions; bits of filter per contained trigram of the largest language; most cells of a filter that is broadcast; languages per cell word.
HASHES, BITS_PER_GRAM, MAX_CELLS, PER_WORD = 4, 12, 1 << 22, 62
#: Share of its share in the language that uses it most from which a trigram is contained; least count.
FAIR_SHARE, LEAST = 0.2, 2
#: Characters that are counted together.
CHUNK = 1 << 18
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def trigrams(text: str) -> np.ndarray:
    """All trigrams of the lower-cased text, its words set apart by single blanks; three code points in 63 bits each."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate(([32], np.where(letter, points, 32), [32]))
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    return points[:-2] | (points[1:-1] << 21) | (points[2:] << 42)


def cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash function: the upper bits of products with odd numbers, after one mixing step."""
    x = grams.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD[0])
    x ^= x >> np.uint64(29)
    return [((x * np.uint64(a)) >> np.uint64(64 - bits)).astype(np.int64) for a in _ODD[:HASHES]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)

    def fold(lang: str) -> None:
        grams, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        size.pop(lang)
        if lang in sums:
            both, back = np.unique(np.concatenate((sums[lang][0], grams)), return_inverse=True)
            total = np.bincount(back, np.concatenate((sums[lang][1], counts)), len(both)).astype(np.int64)
            sums[lang] = both, total
        else:
            sums[lang] = grams, counts

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in list(waiting):
            fold(lang)
        for lang, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_t").to_pylist(), strict=True):
            grams = trigrams(text)
            waiting[lang].append(grams)
            size[lang] += len(grams)
            if size[lang] > CHUNK:
                fold(lang)
        if sum(len(g) for g, _ in sums.values()) > 16 * CHUNK:  # bounded memory for scripts with very many trigrams
            yield from flush()
    yield from flush()


class Model(NamedTuple):
    langs: list[str]
    bits: int
    masks: list[np.ndarray]  # one array of cells for every PER_WORD languages
    false_rate: np.ndarray
    table: DataFrame | None = None  # instead of the filters: gram, lang (its place in langs)


def _cells_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(cells(batch.column("gram").to_numpy(), bits))
            word, mask = (np.tile(batch.column(c).to_numpy(), HASHES) for c in ("word", "mask"))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word), pa.array(mask)], ["cell", "word", "mask"])

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """From all rows that have a language."""
    text_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("_t"))
    counts = cut(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: (r["n"], r["k"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= LEAST).alias("k")).collect()}  # a row for each language
    langs = sorted(totals, key=lambda x: (-totals[x][0], x))
    if not langs:
        return Model([], 1, [], np.zeros(0))
    bits = max(10, (BITS_PER_GRAM * max(k for _, k in totals.values())).bit_length())
    known = docs.sparkSession.createDataFrame([(x, totals[x][0], i, i // PER_WORD, 1 << (i % PER_WORD)) for i, x in enumerate(langs)], "lang string, total long, i int, word int, bit long")
    shares = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total"))
    top = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("i", "word", "bit", "share", "n")).alias("uses"))  # an entry for each language
    contained = top.select("gram", F.explode(F.filter("uses", lambda u: (u["share"] >= FAIR_SHARE * F.col("top")) & (u["n"] >= LEAST))).alias("u"))
    if 1 << bits > MAX_CELLS:
        return Model(langs, bits, [], np.zeros(len(langs)), cut(contained.select("gram", F.col("u.i").alias("lang")), "contained"))
    masks = contained.groupBy("gram", F.col("u.word").alias("word")).agg(F.bit_or("u.bit").alias("mask"))
    filled = masks.mapInArrow(_cells_of(bits), "cell long, word int, mask long").groupBy("word", "cell").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = [np.zeros(1 << bits, np.int64) for _ in range(-(-len(langs) // PER_WORD))]
    for word, own in filled.groupby("word"):
        out[word][own["cell"].to_numpy()] = own["mask"].to_numpy()
    fill = [np.count_nonzero(out[i // PER_WORD] & (1 << (i % PER_WORD))) / (1 << bits) for i in range(len(langs))]
    return Model(langs, bits, out, np.array(fill) ** HASHES)


def predict(model: Model, text: str | None) -> tuple[str, float, float]:
    """Language, score, and the share of the text's trigrams that the language contains; of a model with filters."""
    grams = trigrams(text or "")
    if not len(grams) or not model.langs:
        return "und", 0.0, 0.0
    hits = np.zeros(len(model.langs))
    at = cells(grams, model.bits)
    for w, table in enumerate(model.masks):
        mask = table[at[0]]
        for a in at[1:]:
            mask = mask & table[a]
        for i in range(w * PER_WORD, min(len(model.langs), (w + 1) * PER_WORD)):
            hits[i] = np.count_nonzero(mask & (1 << (i % PER_WORD)))
    true = np.maximum((hits - len(grams) * model.false_rate) / (1 - model.false_rate), 0)
    best, total = int(true.argmax()), true.sum()
    return model.langs[best], float(true[best] / total) if total else 0.0, min(1.0, float(true[best] / len(grams)))


def _predictor(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for batch in batches:
            found = [predict(model, x) for x in batch.column("_t").to_pylist()]
            rest = [n for n in batch.schema.names if n != "_t"]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *columns], [*rest, "lang_pred", "score", "coverage"])

    return run


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column("_key").to_pylist(), batch.column("_t").to_pylist(), strict=True):
            every = trigrams(text)
            grams, n = np.unique(every, return_counts=True)
            if len(grams):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), key)), pa.array(grams), pa.array(n), pa.array(np.full(len(grams), len(every)))], ["_key", "gram", "n", "all"])


def _joined(rows: DataFrame, model: Model) -> DataFrame:
    """What ``predict`` says, by a join of the texts' trigrams to the table of the contained ones."""
    rows = cut(rows.withColumn("_key", F.monotonically_increasing_id()), "texts")
    grams = rows.select("_key", "_t").mapInArrow(_text_grams, "_key long, gram long, n long, all long")
    hits = grams.join(model.table, "gram", "left").groupBy("_key", "lang").agg(F.sum("n").alias("n"), F.max("all").alias("all"))
    found = F.col("lang").isNotNull()
    best = hits.groupBy("_key").agg(F.max(F.when(found, F.struct("n", (-F.col("lang")).alias("back")))).alias("best"), F.sum(F.when(found, F.col("n"))).alias("sum"), F.max("all").alias("all"))
    names = F.array(*[F.lit(x) for x in model.langs])
    named = best.select("_key", F.element_at(names, 1 - F.coalesce("best.back", F.lit(0))).alias("lang_pred"), F.coalesce(F.col("best.n") / F.col("sum"), F.lit(0.0)).alias("score"), F.coalesce(F.col("best.n") / F.col("all"), F.lit(0.0)).alias("coverage"))
    return rows.join(named, "_key", "left").select("_row", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """_row (all columns of ``docs``), lang_pred, score, coverage."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_or_empty(text_col).alias("_t"))
    if model.table is not None:
        return _joined(rows, model)
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())]
    return rows.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model)), T.StructType([rows.schema["_row"], *found]))


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", least_coverage: float = 0.3) -> DataFrame:
    """The rows whose text is in a learned language: not ``und``, and at least this share of its trigrams known."""
    model = train(docs.where(fold_bucket(F.col(id_col), 5) != 0), text_col, lang_col)
    return identify(docs, model, text_col).where((F.col("lang_pred") != "und") & (F.col("coverage") >= least_coverage)).select("_row.*")
