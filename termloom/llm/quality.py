"""Quality classification by positive-unlabelled learning.

A small network over style features minimises the non-negative unbiased risk
pi R_p(+) + max(0, R_u(-) - pi R_p(-)) from trusted positives, unlabelled texts and
an estimated class prior pi; where the inner term falls below zero its gradient is
reversed. The features look at bytes, words and repetition only, over whole texts.
Texts labelled as negative are unlabelled ones like any other.

The prior is estimated from positives and unlabelled texts alone: a network fitted to one
half of both ranks the other half, and where the ranking is purest, the share of
unlabelled texts above a cut over the share of positives above it is (at most) pi.

The fit uses a bounded sample: about ``max_positives`` labelled and ``max_unlabelled``
other rows, chosen by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import crc_fold, hash_words, small_batches, text_chunks, word_bounds
from termloom.session import spread

MAX_POSITIVES, MAX_UNLABELLED, DEFAULT_PRIOR = 4000, 8000, 0.8
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 16, 40, 512, 3e-3, 1e-4
#: Prior under which the ranking for the estimate is fitted, and the estimate's confidence.
RANKING_PRIOR, DOUBT = 0.7, 0.1
_STEPS = 1_000_000
_CLASSES = 16


def _byte_classes() -> np.ndarray:
    """A class for every byte: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line end,
    5 beyond ASCII, 6 full stop or comma, 7 quotes, 8 ! or ?, 9 brackets, 10 # * ~ ^ _ ` = +,
    11 $ % & @, 12 | / and backslash, 13 - : ;, 14 < >, 15 the rest."""
    out = np.full(256, 15, np.uint8)
    out[128:] = 5
    for cls, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", "", ".,", "'\"", "!?", "()[]{}", "#*~^_`=+", "$%&@", "|/\\", "-:;", "<>")):
        for c in chars:
            out[ord(c)] = cls
    return out


_CLASS = _byte_classes()
N_FEATURES = _CLASSES * _CLASSES + 8


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text laid end to end; an empty text is all zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, N_FEATURES))
    if not len(buf):
        return out
    doc = np.repeat(np.arange(n), size)
    cls = _CLASS[buf].astype(np.int64)
    pair = np.empty(len(buf), np.int64)
    pair[0] = cls[0] + _CLASSES * 4
    pair[1:] = cls[:-1] * _CLASSES + cls[1:]
    heads = offsets[:-1][size > 0]
    pair[heads] = cls[heads] + _CLASSES * 4  # a text begins as if after a line end
    counts = np.bincount(doc * _CLASSES**2 + pair, minlength=n * _CLASSES**2).reshape(n, -1)
    out[:, : _CLASSES**2] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    starts, ends = word_bounds(buf, offsets)
    words = hash_words(buf, starts, ends)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    w_doc = np.repeat(np.arange(n), n_words)
    share = lambda flag: np.bincount(w_doc, weights=flag, minlength=n) / np.maximum(n_words, 1)
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (w_doc[1:] == w_doc[:-1])
    order = np.lexsort((words, w_doc))
    known = np.zeros(len(words))
    known[order[1:]] = (words[order[1:]] == words[order[:-1]]) & (w_doc[order[1:]] == w_doc[order[:-1]])
    length = (ends - starts).astype(float)
    first_class, last_class = _CLASS[buf[starts]], _CLASS[buf[ends - 1]]
    extra = [
        share(again),
        share(known),
        share(length) / 10,
        share(length == 1),
        share((last_class > 6)),
        share((first_class == 1) & (last_class == 1)),
        np.log1p(size) / 10,
        np.bincount(doc, weights=buf == 10, minlength=n) / np.maximum(n_words, 1),
    ]
    out[:, _CLASSES**2 :] = np.stack(extra, axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # hidden, hidden bias, output, output bias
    prior: float = DEFAULT_PRIOR

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1])

    def output(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return self.hidden(x) @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.output(x))


def risk(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """The non-negative risk of the weights under the sigmoid loss, its inner term R_u(-) -
    pi R_p(-), and the direction to go down: the risk's gradient, or where the inner term is
    negative the reversed gradient of that term."""

    def pull(x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights for the given slopes of the outputs."""
        h = np.tanh(x @ w[0] + w[1])
        back = np.outer(slope, w[2]) * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ slope, slope.sum()]

    out = lambda x: np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
    su, sp = _sigmoid(out(u)), _sigmoid(out(p))  # loss of calling them negative
    du, dp = su * (1 - su) / len(su), sp * (1 - sp) / len(sp)
    inner = su.mean() - prior * sp.mean()
    down = [a - b for a, b in zip(pull(u, du), pull(p, prior * dp), strict=True)]
    if inner >= 0:
        down = [a + b for a, b in zip(down, pull(p, -prior * dp), strict=True)]
    else:
        down = [-a for a in down]
    return prior * (1 - sp).mean() + max(0.0, inner), inner, down


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Model:
    """Minimise the non-negative risk under the sigmoid loss."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = p.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0

    steps = max(1, -(-len(u) // BATCH))
    for _ in range(EPOCHS):
        up, pp = rng.permutation(len(u)), rng.permutation(len(p))
        for k in range(steps):
            xu, xp = u[up[k::steps]], p[pp[k % len(pp) :: max(1, min(steps, len(pp)))]]
            _, _, grad = risk(w, xp, xu, prior)
            t += 1
            for i in range(4):
                g = grad[i] + DECAY * w[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from outputs alone: of all cuts that of the
    least upper confidence bound of P(unlabelled above) / P(positive above)."""
    a, b = np.sort(positive)[::-1], np.sort(unlabelled)
    held = np.arange(1, len(a) + 1) / len(a)
    above = 1 - np.searchsorted(b, a, "left") / len(b)
    slack = np.sqrt(np.log(4 / DOUBT) / 2) * (len(a) ** -0.5 + len(b) ** -0.5)
    k = int(np.argmin((above + slack) / held))
    return float(np.clip(above[k] / held[k], 0.01, 0.99))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """The mean of both halves' estimates, each ranked by a network fitted to the other half;
    ``DEFAULT_PRIOR`` where there are too few texts to halve."""
    if min(len(positive), len(unlabelled)) < 4:
        return DEFAULT_PRIOR
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    found = []
    for k in (0, 1):
        ranking = train(positive[p[k::2]], unlabelled[u[k::2]], RANKING_PRIOR)
        found.append(estimate_prior(ranking.output(positive[p[1 - k :: 2]]), ranking.output(unlabelled[u[1 - k :: 2]])))
    return float(np.mean(found))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: Column | None = None, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Fit on the rows of ``docs`` that ``usable`` (an expression over the id, used on both
    tables) keeps. None without any positive label. Of several labels of an id the
    rounded mean counts; null labels and ids are ignored."""
    small_batches(docs.sparkSession)
    use = usable if usable is not None else F.lit(True)
    key = F.col(f"`{id_col}`")
    marked = labels.filter(use).select(key.alias("id"), F.col(f"`{label_col}`").alias("y")).dropna().groupBy("id").agg(F.round(F.avg("y")).cast("int").alias("y")).filter("y = 1")
    n_pos = marked.count()
    if not n_pos:
        return None
    pool = docs.filter(use).select(key.alias("id"), F.col(f"`{text_col}`").alias("text"))
    total = pool.select("id").count()
    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(_STEPS)) / _STEPS
    known = marked.filter(draw(21) < min(1.0, max_positives / n_pos))  # about max_positives rows, whatever the labels are
    drawn = pool.withColumn("u", draw(22) < min(1.0, max_unlabelled / max(1, total)))
    chosen = drawn.join(F.broadcast(known), "id", "left").filter("u OR y IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in text_chunks(batch.column("text"), 1 << 20):
                x = features(buf, offsets)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("u"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "u", "y", "x"])

    got = chosen.select("id", "u", "y", "text").mapInArrow(run, "id string, u boolean, y int, x array<double>").toArrow().sort_by("id")
    if not got.num_rows:
        return None
    x = np.array(got.column("x").to_pylist())
    y = got.column("y").to_numpy(zero_copy_only=False).astype(float)
    u = np.array(got.column("u").to_pylist(), bool)
    if not (y == 1).any() or not u.any():
        return None
    return train(x[y == 1], x[u], class_prior(x[y == 1], x[u]))


def classify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1, higher is better) and ``predicted``.

    Null text counts as empty, which is scored like any other; without a model every
    score is the default prior. Repeated rows are scored alike. Columns of ``docs`` with
    the new names give way to them.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = np.full(batch.num_rows, DEFAULT_PRIOR)
            if model is not None:
                for i, j, buf, offsets in text_chunks(batch.column(batch.schema.names.index(text_col)), 1 << 20):
                    score[i:j] = model.score(features(buf, offsets))
            add = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *add], names=[*batch.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, usable=crc_fold(F.col("doc_id")) != 1)
    held_out = (crc_fold(F.col("doc_id")) == 1).alias("held_out")
    return classify(spread(docs.select("doc_id", held_out, "text")), model).select("doc_id", "held_out", "score", "predicted")
