"""Quality classifier: random-indexing word vectors pooled per document, and a calibrated two-layer network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm import _common as C

#: Labelled documents that the vectors and the network are fitted on, at most (the ones of least id hash).
FIT_ROWS = 6000
#: Hashed words, word shapes, dimensions, non-zero entries of an index vector, words of context on either side.
WORDS, SHAPES, DIMS, NONZERO, CONTEXT = 1 << 13, 64, 64, 6, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
#: Tasks that sum context vectors of the fitting rows.
FIT_TASKS = 8

_CLASS = np.full(256, 3, np.uint8)  # punctuation
_CLASS[C.SPACE] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
_SIZE = np.minimum(np.searchsorted([1, 2, 3, 5, 8, 12, 16], np.arange(256), "left"), 7)


def _runs(data: np.ndarray, offsets: np.ndarray):
    """Runs of letters, of digits and of punctuation: starts, ends, first run of each document."""
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if len(data):
        edge[1:-1] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    live = kind[starts] > 0
    starts, ends = starts[live], ends[live]
    return starts, ends, np.searchsorted(starts, offsets)


def tokens(column):
    """(word, shape, first) of a text column: hashed words and shapes (kind, case, length) run by run."""
    data, offsets = C.text_bytes(column)
    words, shapes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for a, b in C.chunks(offsets):
        own = data[offsets[a] : offsets[b]]
        starts, ends, first = _runs(own, offsets[a : b + 1] - offsets[a])
        words.append((C.byte_hash(own, starts, ends, 0) >> np.uint64(40)).astype(np.int64) % WORDS)
        upper, lower = (np.concatenate([[0], np.cumsum(m[own])]) for m in (_UPPER, _LOWER))
        n_up, n_low = upper[ends] - upper[starts], lower[ends] - lower[starts]
        kind = _CLASS[own[starts]] if len(starts) else np.zeros(0, np.uint8)
        case = np.where(kind == 2, 4, np.where(kind == 3, 5, np.where(n_up == 0, 0, np.where((n_up == 1) & _UPPER[own[starts]], 1, np.where(n_low == 0, 2, 3)))))
        shapes.append(case * 8 + _SIZE[np.minimum(ends - starts, 255)])
        counts.append(np.diff(first))
    return np.concatenate(words), np.concatenate(shapes), np.cumsum(np.concatenate(counts))


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each word's and shape's index vector."""
    own = np.random.Generator(np.random.PCG64(11))
    return own.integers(0, DIMS, (WORDS + SHAPES, NONZERO)), own.choice([-1.0, 1.0], (WORDS + SHAPES, NONZERO))


def context_sums(words: np.ndarray, shapes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word and shape, the sum of the index vectors of the words and shapes around its occurrences."""
    place, sign = _index_vectors()
    total = np.zeros((WORDS + SHAPES) * DIMS)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a in range(0, len(words), 1 << 16):
        here = np.arange(a, min(a + (1 << 16), len(words)))
        for step in (x for x in range(-CONTEXT, CONTEXT + 1) if x):
            near = here + step
            fits = (near >= 0) & (near < len(words))
            i, j = here[fits], near[fits]
            same = doc[i] == doc[j]
            i, j = i[same], j[same]
            for target in (words[i], shapes[i] + WORDS):
                for source in (words[j], shapes[j] + WORDS):
                    at = (target[:, None] * DIMS + place[source]).ravel()
                    total += np.bincount(at, sign[source].ravel(), len(total))
    return total.reshape(-1, DIMS)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Each word's unit context vector plus its own unit index vector."""
    place, sign = _index_vectors()
    own = np.zeros((WORDS + SHAPES, DIMS))
    np.add.at(own, (np.arange(WORDS + SHAPES)[:, None], place), sign)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return (unit(sums) + unit(own)).astype(np.float32)


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """Per text: the mean vector of its words, of its shapes, and the logarithm of its length; an empty text is zeros."""
    words, shapes, first = tokens(column)
    counts, n = np.diff(first), len(first) - 1
    out = np.zeros((n, 2 * DIMS + 1), np.float32)
    some = np.flatnonzero(counts)
    step = 1 << 16
    for a in range(0, len(words), step):  # sums over pieces, so that long texts stay in bounded memory
        b = min(a + step, len(words))
        docs = some[np.searchsorted(first[some], a, "right") - 1 : np.searchsorted(first[some], b)]
        out[docs, :DIMS] += np.add.reduceat(vectors[words[a:b]], np.maximum(first[docs] - a, 0), axis=0)
    table = np.bincount(np.repeat(np.arange(n), counts) * SHAPES + shapes, minlength=n * SHAPES).reshape(n, SHAPES)
    out[:, DIMS : 2 * DIMS] = table @ vectors[WORDS:]
    out[:, : 2 * DIMS] /= np.maximum(counts, 1)[:, None]
    out[:, -1] = np.log1p(counts)
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple  # w1, b1, w2, b2
    temperature: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward((features - self.mean) / self.scale, self.layers)[1] / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(x: np.ndarray, layers) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, hidden @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> tuple:
    """Two layers by Adam on the logistic loss; without both classes, a constant."""
    own = np.random.default_rng(seed)
    layers = [own.normal(size=(x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), own.normal(size=HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(1)]
    if len(set(y.tolist())) < 2:
        return np.zeros((x.shape[1], HIDDEN)), layers[1], np.zeros(HIDDEN), np.array([4.0 if len(y) and y[0] else -4.0 if len(y) else 0.0])
    layers[3][:] = np.log(y.mean() / (1 - y.mean()))
    moment, square, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        order = own.permutation(len(x))
        for a in range(0, len(x), 64):
            bx, by = x[order[a : a + 64]], y[order[a : a + 64]]
            hidden, z = _forward(bx, layers)
            dz = (_sigmoid(z) - by) / len(bx)
            dh = np.outer(dz, layers[2]) * (hidden > 0)
            grads = [bx.T @ dh + DECAY * layers[0], dh.sum(0), hidden.T @ dz + DECAY * layers[2], np.array([dz.sum()])]
            step += 1
            for i, g in enumerate(grads):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                layers[i] = layers[i] - RATE * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss."""
    if len(set(y.tolist())) < 2:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(16), 97))
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text is 1 modulo 3 (a null id counts as learnable)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most fit_rows labelled documents that are not held out, the ones of least id hash.

    Null labels and ids are skipped; of several labels of a document the highest counts; of rows of documents that
    share an id the one of least text hash is used, so that there are never more than fit_rows. An empty table and very
    long texts are nothing special: texts count whole. Other columns are not looked at, whatever their names. A fifth of the rows only sets the temperature. Tasks send the driver a context matrix of
    fixed size each, and one feature vector a fitted row. Without any labelled document every score is 0.5; with one
    class only, nearly that class.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(fit_rows)
    own = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    least = own.groupBy(id_col).agg(F.min(F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))).alias("_least"), F.first("_label").alias("_label"))
    rows = C.materialize(least.select(id_col, F.col("_least.t").alias(text_col), "_label").repartition(FIT_TASKS, id_col), "fit")

    def contexts(batches):
        total = np.zeros((WORDS + SHAPES, DIMS))
        for batch in batches:
            total += context_sums(*tokens(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], ["sums"])

    sums = np.zeros((WORDS + SHAPES, DIMS))
    for (part,) in rows.select(text_col).mapInArrow(contexts, "sums binary").collect():
        sums += np.frombuffer(part, "<f4").reshape(sums.shape)
    vectors = word_vectors(sums)
    given = spark.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            x = pooled(batch.column(2), given.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], [id_col, "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = sorted(tuple(r) for r in rows.select(id_col, F.col("_label").cast("int"), text_col).mapInArrow(features, f"`{id_col}` {kind}, y int, x binary").collect())
    y = np.array([r[1] for r in found], float)
    x = np.array([np.frombuffer(r[2], np.float32) for r in found], float).reshape(len(found), 2 * DIMS + 1)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(2 * DIMS + 1), np.ones(2 * DIMS + 1))
    x = (x - mean) / scale
    aside = np.arange(len(x)) % 5 == 4
    layers = train(x[~aside], y[~aside])
    return QualityModel(vectors, mean, scale, layers, calibrate(_forward(x[aside], layers)[1], y[aside]))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1, higher for better) and predicted (1 from 0.5 on), under other names if given.

    Only the whole text counts; null and empty texts get the score of an empty text. Other columns pass through, and
    those of the two names are replaced. Equal texts score alike.
    """
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            _, offsets = C.text_bytes(batch.column(at))
            for a, b in C.chunks(offsets):
                part = batch.slice(a, b - a)
                score = given.value.score(pooled(part.column(at), given.value.vectors).astype(float))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*part.schema.names, *names])

    return docs.mapInArrow(run, docs.withColumns(dict(zip(names, (F.lit(0.0), F.lit(0)), strict=True))).schema)


def drop_rejected(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay as they are, whatever their names."""
    names = C.free_name(docs, "score"), C.free_name(docs, "predicted")
    return score_quality(docs, model, text_col, names).where(f"`{names[1]}` = 1").select(docs.columns)
