"""Quality classifier: Naive Bayes support vectors.

Features are n-gram indicators: runs of 1 and 2 words, and of 1 to 3 word shapes (letter case, digits,
marks at either end, length, whether the word is one of the last few again), hashed. Each is scaled by
its log-count ratio between the classes and a linear hinge-loss model is fitted to the scaled, length-
normalised indicators by dual coordinate descent; a logistic curve over the margin gives the score.

The fit takes a bounded sample of labelled rows, whole texts: at most MOST_ROWS, the first by a hash of doc_id, and of
these, in that order, each that still fits into MOST_CHARACTERS, so that one very long text is passed over and not all
after it. It needs both classes, or else every score is the share of label 1 (1 without labels). A null text is the empty
text: it has no features, so its score is the curve's value at the bias. Rows are scored one by one:
repeated rows score alike, extra columns are not read. A null doc_id is never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm import kernels
from ledgerframe.llm.common import remainder, tune

#: Labelled rows that the model is fitted to, at most.
MOST_ROWS = 8000
#: Characters of the sampled texts that the driver holds at most.
MOST_CHARACTERS = 32_000_000
DIMENSIONS = 1 << 20
THRESHOLD = 0.3
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
#: Of the sample, one row in so many sets the logistic curve and not the weights.
CALIBRATION = 5
#: A word counts as a repeat if it is one of so many before it.
LOOK_BACK = 4

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[0x80:] = 4
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _CLASS[_b] = 5 + _b % 27


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all texts, and where each text's begin (one more entry)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    words, begins = kernels.word_hashes(raw)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = kernels._SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    kinds = _CLASS[data]
    upper = np.concatenate(([0], np.cumsum(kinds == 2)))
    length = ends - starts
    uppers = upper[ends] - upper[starts]
    case = np.where(uppers == 0, 0, np.where((uppers == length) & (length > 1), 3, np.where((uppers == 1) & (kinds[starts] == 2), 1, 2)))
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    again = np.zeros(n, np.int64)
    for back in range(1, LOOK_BACK + 1):
        same = np.zeros(n, bool)
        same[back:] = (words[back:] == words[:-back]) & (owner[back:] == owner[:-back])
        again = np.where((again == 0) & same, 1, again)
    shape = (case + 4 * np.minimum(length, 15) + 64 * kinds[starts].astype(np.int64) + 64 * 32 * kinds[ends - 1].astype(np.int64)).astype(np.uint64) * np.uint64(2) + again.astype(np.uint64)
    # a coarser view, without length, joins with its neighbours
    coarse = (case + 4 * again + 8 * kinds[ends - 1].astype(np.int64)).astype(np.uint64)
    made, owners = [], []

    def add(values: np.ndarray, own: np.ndarray, kind: int) -> None:
        made.append(kernels.mixed(values + np.uint64(kind * 0x5851F42D4C957F2D % (1 << 64))) & np.uint64(DIMENSIONS - 1))
        owners.append(own)

    add(words, owner, 1)
    add(shape, owner, 2)
    add(coarse, owner, 3)
    for kind, of, width in ((4, words, 2), (5, coarse, 2), (6, coarse, 3)):
        if n >= width:
            both = of[: n - width + 1].copy()
            for j in range(1, width):
                both = both * kernels.ODD + of[j : n - width + 1 + j]
            same = owner[: n - width + 1] == owner[width - 1 :]
            add(both[same], owner[: n - width + 1][same], kind)
    key = np.concatenate(owners).astype(np.int64) * DIMENSIONS + np.concatenate(made).astype(np.int64)
    key = np.unique(key)
    return key % DIMENSIONS, np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) * DIMENSIONS)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope x margin + offset))); margin = sum of w_i r_i / |r of the row| + bias."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, found: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.full(len(begins) - 1, self.bias)
        r = self.ratios[found]
        sums = np.concatenate(([0.0], np.cumsum(r * self.weights[found], dtype=np.float64)))
        norm = np.concatenate(([0.0], np.cumsum(r * r, dtype=np.float64)))
        length = np.sqrt(np.maximum(norm[begins[1:]] - norm[begins[:-1]], 1e-12))
        return (sums[begins[1:]] - sums[begins[:-1]]) / length + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        sizes = [(t or "").encode("utf-8", "replace") for t in texts]
        for i, j in kernels.chunks(sizes):
            out[i:j] = self.margins(*features(texts[i:j]))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * out + self.offset, -40, 40)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """The weights and bias of a linear hinge-loss model, by dual coordinate descent over sparse rows."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i], values[i]
            slope = signs[i] * (float(w[at] @ v) + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if step := (new - alpha[i]) * signs[i]:
                w[at] += step * v
                bias += step
                most = max(most, abs(step))
            alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """A logistic curve over margins by Newton steps, with smoothed targets so that it stays finite."""
    ones, zeros = float(label.sum()), float((1 - label).sum())
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    at = np.array([1.0, np.log((ones + 1) / (zeros + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (target - p) - 1e-3 * at)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(at[0], 0.1)), float(at[1])


def fit_texts(texts: list[str | None] | pa.ChunkedArray, labels: list[int]) -> Model:
    """The model of a sample in memory; texts are worked on a portion at a time, and the rows' features are held once."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    column = texts if isinstance(texts, pa.ChunkedArray) else pa.chunked_array([pa.array(texts, pa.string())])
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64) + 1)
    cuts = [0, *np.searchsorted(ends, np.arange(kernels.CHUNK, ends[-1], kernels.CHUNK)).tolist(), len(y)]
    found, begins = [], [np.zeros(1, np.int64)]
    seen = np.full((2, DIMENSIONS), SMOOTHING)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        f, b = features(column.slice(i, j - i).to_pylist())
        own = np.repeat(y[i:j], np.diff(b))
        for k in (0, 1):
            seen[k] += np.bincount(f[own == k], minlength=DIMENSIONS)
        found.append(f.astype(np.int32))
        begins.append(b[1:] + begins[-1][-1])
    f, b = np.concatenate(found), np.concatenate(begins)
    del found
    q, p = seen
    ratios = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    # a feature that one row in the sample has says nothing about others
    ratios[p + q < 2 + 2 * SMOOTHING] = 0.0
    del seen, p, q
    scaled = ratios[f]
    rows, values = [], []
    for i, j in zip(b[:-1], b[1:], strict=True):
        scaled[i:j] /= max(1e-6, float(np.sqrt((scaled[i:j] ** 2).sum())))
        rows.append(f[i:j])
        values.append(scaled[i:j])
    set_aside = np.arange(len(y)) % CALIBRATION == 0
    if min(len(set(y[set_aside])), len(set(y[~set_aside]))) < 2:
        set_aside = np.zeros(len(y), bool)
    kept = np.flatnonzero(~set_aside)
    w, bias = descend([rows[i] for i in kept], [values[i] for i in kept], np.where(y[kept] == 1, 1.0, -1.0), DIMENSIONS)
    held = np.flatnonzero(set_aside) if set_aside.any() else kept
    margin = np.array([float(w[rows[i]] @ values[i]) + bias for i in held])
    return Model(ratios, w.astype(np.float32), bias, *_curve(margin, y[held]))


def fitting(sizes: list[int], most: int) -> list[bool]:
    """Which of texts in order are taken, if each is that still fits."""
    out, held = [], 0
    for n in sizes:
        out.append(held + n <= most)
        held += n if out[-1] else 0
    return out


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS, most_characters: int = MOST_CHARACTERS) -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, quality), from rows whose crc32(doc_id) mod 5 is not 0.

    A doc_id with several labels has the least; one with several texts the least by hash.
    """
    spark = docs.sparkSession
    drawn = labels.where(F.col("quality").isin(0, 1) & (remainder("doc_id", 5) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = drawn.withColumn("_at", F.xxhash64("doc_id")).orderBy("_at", "doc_id").limit(most_rows)  # bounded: broadcast
    tied = F.struct(F.xxhash64("text").alias("tie"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sizes = met.groupBy("doc_id").agg(F.min(tied).alias("t"), F.first("_at").alias("_at")).orderBy("_at", "doc_id").select("doc_id", "t.tie", "t.size").toArrow()  # most_rows rows of three numbers
    taken = fitting(sizes["size"].to_pylist(), most_characters)
    chosen = spark.createDataFrame(sizes.select(["doc_id", "tie"]).filter(pa.array(taken, pa.bool_())))
    texts = met.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("tie")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("_at").alias("_at"))
    sample = texts.orderBy("_at", "doc_id").select("text", "quality").toArrow()
    model = fit_texts(sample["text"], sample["quality"].to_pylist())
    del sample
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Per row of docs: the columns `keep` and score."""
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model)  # bounded: DIMENSIONS floats twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(held.value.scores(b.column(len(keep)).to_pylist()))], names)

    names = [*(f"_keep_{i}" for i in range(len(keep))), "score"]
    kinds = [f"_keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    source = docs.select(*(F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    out = source.mapInArrow(run, ", ".join([*kinds, "score double"]))
    return out.select(*(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), F.col("score").alias("_score"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted. A null doc_id is held out."""
    out = score(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay."""
    out = score(docs, fit(docs, labels), docs.columns)
    return out.where(F.col("_score") >= THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
