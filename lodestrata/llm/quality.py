"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Words are reduced to forms (lower-case core, outer punctuation, a mark for capitals, a mark for a word that repeats the
one before).  Each frequent form has a sparse random index vector; its word vector is its own index vector plus the sum
of the index vectors that stand near it in the fitting sample.  A document is the mean of its words' vectors.  The
network's probabilities are calibrated by a temperature fitted on held-back rows of the sample.

The classifier is fitted on a bounded sample of labelled rows, ``SAMPLE_DOCS`` in the order of a hash of the id; every
row's whole text is scored.  Only the text is an input of a score.

Defined results: null and empty texts are scored as a text without words.  Labelled rows without a quality, labels
without a document and held-out rows teach nothing.  If fewer than two classes can be learned from, the score is the
share of label 1 among the learned rows (0.5 if there are none).  Rows that repeat are scored alike;
of labels that repeat an id the larger counts.  A very long text is read whole, in fitting too.  An empty table gives an
empty result.  Columns of any name are carried in a struct.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import cut, text_batches, text_or_empty

#: Bounds of the fit: labelled rows, forms with a vector, forms of one text that the word vectors learn from.
SAMPLE_DOCS, FORMS = 8000, 20_000
DIMENSIONS, NONZERO, NEAR, HIDDEN, EPOCHS, SEED = 128, 8, 2, 32, 60, 17
CACHED_WORDS = 200_000
CAPITALS, REPEATED, OTHER = "<capitals>", "<repeated>", "<other>"
_PARTS = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)


def forms(word: str) -> list[str]:
    before, core, after = _PARTS.match(word).groups()
    out = [before] if before else []
    if core:
        out.append(core.lower())
        if len(core) > 1 and core.isupper():
            out.append(CAPITALS)
    if after:
        out.append(after)
    return out


def _sequence(text: str) -> list[str]:
    out, last = [], None
    for word in text.split():
        out += forms(word)
        if word == last:
            out.append(REPEATED)
        last = word
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("_t").to_pylist():
            counts.update(set(_sequence(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["form", "n"])


def _encode(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = spread.value
        for batch in batches:
            rows = []
            for text in batch.column("_t").to_pylist():
                s = [index.get(x, index[OTHER]) for x in _sequence(text)]
                head = np.array(s, np.uint16)
                rows.append((head.tobytes(), Counter(s)))
            ids = [np.array(list(c), np.uint16).tobytes() for _, c in rows]
            numbers = [np.array(list(c.values()), np.uint32).tobytes() for _, c in rows]
            yield pa.RecordBatch.from_arrays([batch.column("_q"), pa.array([r[0] for r in rows], pa.binary()), pa.array(ids, pa.binary()), pa.array(numbers, pa.binary())], ["quality", "stretch", "ids", "numbers"])

    return run


class Model(NamedTuple):
    index: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None
    temperature: float
    prior: float


def index_vectors(names: list[str]) -> np.ndarray:
    """Sparse ternary vectors, drawn from a hash of the form."""
    out = np.zeros((len(names), DIMENSIONS), np.float32)
    for i, name in enumerate(names):
        rng = np.random.default_rng(zlib.crc32(name.encode()))
        out[i, rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return out


def word_vectors(names: list[str], sequences: list[np.ndarray]) -> np.ndarray:
    """Own index vector plus the direction of the summed index vectors within ``NEAR`` places."""
    own = index_vectors(names)
    near = np.zeros_like(own)
    joined = np.concatenate([np.concatenate((s, np.full(NEAR, len(names)))) for s in sequences]).astype(np.int64) if sequences else np.zeros(0, np.int64)
    for at in range(0, len(joined), 1 << 21):
        part = joined[at : at + (1 << 21)]
        for step in range(1, NEAR + 1):
            a, b = part[:-step], part[step:]
            both = (a < len(names)) & (b < len(names))
            pairs, n = np.unique(a[both] * len(names) + b[both], return_counts=True)
            a, b = pairs // len(names), pairs % len(names)
            for x, y in ((a, b), (b, a)):
                order = np.argsort(x, kind="stable")
                x, y, w = x[order], y[order], n[order]
                for lo in range(0, len(x), 1 << 17):
                    xs = x[lo : lo + (1 << 17)]
                    starts = np.flatnonzero(np.concatenate(([True], np.diff(xs) != 0)))
                    near[xs[starts]] += np.add.reduceat(own[y[lo : lo + (1 << 17)]] * w[lo : lo + (1 << 17), None].astype(np.float32), starts, axis=0)
    length = np.linalg.norm(near, axis=1, keepdims=True)
    return own / np.sqrt(NONZERO) + near / np.where(length > 0, length, 1)


def pooled(vectors: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.float32) @ vectors[ids] / max(1, numbers.sum()) if len(ids) else np.zeros(DIMENSIONS, np.float32)


def _forward(layers, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.maximum(x @ w1 + b1, 0)
    return h, h @ w2 + b2[0]


def _network(x: np.ndarray, y: np.ndarray) -> tuple[tuple, float]:
    """Adam on the cross entropy; the epoch with the least loss on every eighth row, and the temperature that suits these rows best."""
    rng = np.random.default_rng(SEED)
    back = np.arange(len(y)) % 8 == 7
    if len(np.unique(y[back])) < 2:
        back = np.zeros(len(y), bool)
    check = back if back.any() else ~back
    tx, ty = x[~back], y[~back]
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    best, kept = np.inf, [p.copy() for p in layers]
    loss = lambda z, t: float(np.mean(np.logaddexp(0, z) - t * z))
    for _ in range(EPOCHS):
        order = rng.permutation(len(ty))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            h, z = _forward(layers, tx[rows])
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - ty[rows]) / len(rows)
            gh = np.outer(g, layers[2]) * (h > 0)
            grads = [tx[rows].T @ gh + 1e-4 * layers[0], gh.sum(0), h.T @ g + 1e-4 * layers[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                layers[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        now = loss(_forward(layers, x[check])[1], y[check])
        if now < best:
            best, kept = now, [p.copy() for p in layers]
    z = _forward(kept, x[check])[1]
    return tuple(kept), float(min(np.geomspace(0.3, 5, 60), key=lambda t: loss(z / t, y[check])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """From the rows given; the caller leaves held-out rows away."""
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_q"))
    picked = F.broadcast(known.orderBy(F.xxhash64(F.col("_id").cast("long")), "_id").limit(sample_docs))  # bounded by sample_docs
    sample = cut(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t")).join(picked, "_id").select("_id", "_q", "_t"), "sample")
    tally = sample.select("_t").mapInArrow(_tally, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    names = [r["form"] for r in tally.orderBy(F.desc("n"), "form").limit(FORMS).collect()]
    names = [n for n in names if n != OTHER] + [OTHER]
    index = {n: i for i, n in enumerate(names)}
    rows = sample.select("_id", "_q", "_t").mapInArrow(_with_id(_encode(spark.sparkContext.broadcast(index))), "_id long, quality int, stretch binary, ids binary, numbers binary").toPandas().sort_values(["_id"], kind="stable")
    vectors = word_vectors(names, [np.frombuffer(x, np.uint16) for x in rows["stretch"]])
    y = rows["quality"].to_numpy(np.float64)
    order = np.random.default_rng(SEED).permutation(len(y))
    x = np.array([pooled(vectors, np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint32)) for a, b in zip(rows["ids"], rows["numbers"], strict=True)]).reshape(-1, DIMENSIONS)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(DIMENSIONS), np.ones(DIMENSIONS))
    prior = float(y.mean()) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return Model(index, vectors, mean, scale, None, 1.0, prior)
    layers, temperature = _network(((x - mean) / scale)[order], y[order])
    return Model(index, vectors, mean, scale, layers, temperature, prior)


def _with_id(encode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in encode(iter([batch])):
                yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), *out.columns], ["_id", *out.schema.names])

    return run


class Scorer:
    def __init__(self, model: Model):
        self.m, self.known = model, {}

    def _ids(self, word: str) -> tuple[int, ...]:
        other = self.m.index[OTHER]
        return tuple(self.m.index.get(f, other) for f in forms(word))

    def features(self, text: str) -> np.ndarray:
        words, known = text.split(), self.known
        ids: list[int] = []
        numbers: list[int] = []
        for word, n in Counter(words).items():
            own = known.get(word)
            if own is None:
                own = known[word] = self._ids(word)
            ids += own
            numbers += [n] * len(own)
        if (again := sum(map(eq, words, words[1:]))) and REPEATED in self.m.index:
            ids.append(self.m.index[REPEATED])
            numbers.append(again)
        if len(known) > CACHED_WORDS:
            known.clear()
        return pooled(self.m.vectors, np.array(ids, np.int64), np.array(numbers, np.int64))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.m.layers is None or not texts:
            return np.full(len(texts), self.m.prior)
        x = (np.array([self.features(t) for t in texts]) - self.m.mean) / self.m.scale
        return 1 / (1 + np.exp(-np.clip(_forward(self.m.layers, x)[1] / self.m.temperature, -50, 50)))


def _scoring(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(spread.value)
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "_t"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(scorer.score(batch.column("_t").to_pylist()), pa.float64())], [*rest, "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """_row (all columns of ``docs``) and score, the calibrated probability of label 1."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_or_empty(text_col).alias("_t"))
    return rows.mapInArrow(_scoring(docs.sparkSession.sparkContext.broadcast(model)), T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType())]))
