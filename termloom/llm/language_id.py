"""Language identification by interpolated Kneser-Ney character models.

One model of order five for each language, over lower-cased letters with everything
else collapsed to single spaces. All models share, for each order, one sorted array
of 64-bit hashes (with a directory on the leading bits) and beside it the smoothed
log-probability under every language, so one search serves all of them. A text goes
to the language of least cross-entropy per character and is rejected where that
exceeds what calibration texts of the language allow at its length.

The models are fitted on a bounded sample: about ``max_docs`` labelled documents of
each language, chosen by a hash of their id; a fifth of them only calibrates, unless the
language has no others. Whole texts are used throughout, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import crc_fold, mix, small_batches, text_chunks
from termloom.session import spread

ORDER, MAX_DOCS, BITS, UNKNOWN_LANGUAGE = 5, 2000, 12, "und"
#: Characters of a language, and documents of all languages together, that a fit uses at most (about).
MAX_CHARS, MAX_TOTAL = 20_000_000, 60_000
#: Characters scored at once; nats of slack on calibration, fixed and by the root of the length.
CHUNK, SLACK, SHORT = 400_000, 1.0, 6.0
_SPACE, _STEPS = 0x20, 1_000_000
#: Bytes of text folded at once.
PIECE = 4 << 20


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Lower-cased letter, or a space, for every code point of the first plane."""
    out = np.full(0x10000, _SPACE, np.uint32)
    for i in range(0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def folded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of texts laid end to end and the offsets of each text in them."""
    chars = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offsets]
    x = _fold_table()[np.minimum(chars, 0xFFFF)]
    far = np.flatnonzero(chars > 0xFFFF)
    if len(far):
        x[far] = [ord(c.lower()[0]) if (c := chr(v)).isalpha() else _SPACE for v in chars[far].tolist()]
    space = x == _SPACE
    before = np.ones(len(x), bool)
    before[1:] = space[:-1]
    before[ends[:-1][ends[:-1] < len(x)]] = True
    keep = ~(space & before)
    return x[keep], np.concatenate(([0], np.cumsum(keep)))[ends]


def pieces(buf: np.ndarray, offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first text, text after the last, folded code points, offsets of the texts in them, how
    many of the first ones are history only). Texts of up to ``size`` bytes together come at
    once; a longer one comes in pieces, each begun by what its first grams look back on."""
    size = size or PIECE
    if len(buf) <= size:
        yield 0, len(offsets) - 1, *folded(buf, offsets), 0
        return
    for t in range(len(offsets) - 1):
        at, stop, tail = int(offsets[t]), int(offsets[t + 1]), np.zeros(0, np.uint32)
        while at < stop:
            end = min(stop, at + size)
            while end < stop and buf[end] & 0xC0 == 0x80:  # not inside a character
                end += 1
            chars, _ = folded(buf[at:end], np.array([0, end - at]))
            if len(tail) and tail[-1] != _SPACE and not _is_letter(buf, at):
                chars = np.concatenate(([np.uint32(_SPACE)], chars))  # folding drops what a text begins with
            whole = np.concatenate([tail, chars])
            yield t, t + 1, whole, np.array([0, len(whole)]), len(tail)
            tail, at = whole[-(ORDER - 1) :], end


def _is_letter(buf: np.ndarray, at: int) -> bool:
    lead = int(buf[at])
    width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    return buf[at : at + width].tobytes().decode("utf-8").isalpha()


def histories(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every character the packed identifiers of it and the four before it (spaces before a text)."""
    pos = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = ids.astype(np.uint64)
    for k in range(1, ORDER):
        prior = np.zeros(len(ids), np.uint64)
        prior[k:] = ids[:-k]
        prior[pos < k] = 0
        key |= prior << np.uint64(BITS * k)
    return key


class HashedRows:
    """A sorted hash array over distinct keys with one row of values for each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(max(2, len(keys)))))))
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not there."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.hashes):
            return out
        h = mix(keys)
        cell = (h >> self.shift).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.hashes[at[open_]] == h[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def _low(k: int) -> np.uint64:
    return np.uint64((1 << (BITS * k)) - 1)


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, weights=counts, minlength=len(u)).astype(np.float64)


@dataclass
class Model:
    languages: list[str]
    letters: np.ndarray  # code points that have an identifier of their own, sorted
    grams: list[HashedRows]  # by order from 1: log-probabilities
    backoffs: list[HashedRows]  # by order from 2: log of the mass left to the lower order
    unseen: np.ndarray  # log-probability of an unknown character
    limits: np.ndarray | None = None  # mean cross-entropy and allowance of each language

    def identifiers(self, chars: np.ndarray) -> np.ndarray:
        """0 for a space, 1 for an unknown character, else its own."""
        at = np.searchsorted(self.letters, chars)
        at[at == len(self.letters)] = 0
        known = self.letters[at] == chars if len(self.letters) else np.zeros(len(chars), bool)
        return np.where(chars == _SPACE, 0, np.where(known, at + 2, 1)).astype(np.uint64)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        left = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            gram = keys[left] & _low(k)
            row = self.grams[k - 1].find(gram)
            hit = row >= 0
            out[left[hit]] += self.grams[k - 1].values[row[hit]]
            left, gram = left[~hit], gram[~hit]
            if k > 1 and len(left):
                row = self.backoffs[k - 2].find(gram >> np.uint64(BITS))
                hit = row >= 0
                out[left[hit]] += self.backoffs[k - 2].values[row[hit]]
        out[left] += self.unseen
        return out

    def entropies(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per character under each language, characters, letters) of each text."""
        size = len(offsets) - 1
        sums, n, letters = np.zeros((size, len(self.languages))), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for first, last, chars, ends, known in pieces(buf, offsets):
            keys = histories(self.identifiers(chars), ends)
            text = np.repeat(np.arange(first, last), np.diff(ends))
            fresh = np.ones(len(chars), bool)
            fresh[:known] = False  # scored with the piece before
            for i in range(0, len(keys), CHUNK):
                use = np.flatnonzero(fresh[i : i + CHUNK]) + i
                lp, t = self.log_probabilities(keys[use]), text[use]
                heads = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else use
                sums[t[heads]] += np.add.reduceat(lp, heads, axis=0, dtype=np.float64) if len(t) else 0.0
            n += np.bincount(text[fresh], minlength=size)
            letters += np.bincount(text[fresh & (chars != _SPACE)], minlength=size)
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def judge(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        cross, n, letters = self.entropies(buf, offsets)
        best = cross.argmin(axis=1)
        least = cross[np.arange(len(best)), best]
        gap = (cross - least[:, None]) * np.minimum(n, 64)[:, None]
        score = 1 / np.exp(-gap).sum(axis=1)
        mean, allowed = self.limits[best].T
        rejected = least > mean + allowed + SHORT / np.sqrt(np.maximum(n, 1))
        return [(self.languages[b], s, bool(r)) if m else (UNKNOWN_LANGUAGE, 0.0, True) for b, s, r, m in zip(best.tolist(), score.tolist(), rejected.tolist(), letters.tolist(), strict=True)]


def estimate(grams: dict[str, tuple[np.ndarray, np.ndarray]], letters: np.ndarray) -> Model:
    """Interpolated Kneser-Ney models from the counts of packed five-grams of each language."""
    languages = sorted(grams)
    size = len(languages)
    vocabulary = len(letters) + 2
    counts: list[dict] = [{} for _ in range(ORDER + 1)]
    for name in languages:
        keys, n = grams[name]
        counts[ORDER][name] = (keys, n.astype(np.float64))
        for k in range(ORDER - 1, 0, -1):  # how many different characters a gram follows
            keys = counts[k + 1][name][0] & _low(k)
            counts[k][name] = _summed(keys)
    lower = np.full((1, size), 1.0 / vocabulary)
    lower_keys = np.zeros(1, np.uint64)
    tables, backoffs, unseen = [], [], None
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([counts[k][name][0] for name in languages]))
        p = lower[np.searchsorted(lower_keys, keys & _low(k - 1))].copy()
        contexts = np.unique(keys >> np.uint64(BITS))
        mass = np.ones((len(contexts), size))
        for j, name in enumerate(languages):
            own, n = counts[k][name]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.9))
            ctx, total = _summed(own >> np.uint64(BITS), n)
            _, kinds = _summed(own >> np.uint64(BITS))
            at = np.searchsorted(contexts, ctx)
            mass[at, j] = discount * kinds / total
            p[:, j] *= mass[np.searchsorted(contexts, keys >> np.uint64(BITS)), j]
            p[np.searchsorted(keys, own), j] += (n - discount) / total[np.searchsorted(ctx, own >> np.uint64(BITS))]
        tables.append(HashedRows(keys, np.log(p)))
        if k == 1:
            unseen = np.log(mass[0] / vocabulary)
        else:
            backoffs.append(HashedRows(contexts, np.log(mass)))
        lower, lower_keys = p, keys
    return Model(languages, letters, tables, backoffs, unseen)


def _wide_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Five-grams of a text column as two integers of code points, with counts."""
    high, low = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for chars, ends, known in (p[2:] for _, _, buf, offsets in text_chunks(column, 1 << 20) for p in pieces(buf, offsets)):
        pos = np.arange(len(chars)) - np.repeat(ends[:-1], np.diff(ends))
        prior = [chars.astype(np.int64)]
        for k in range(1, ORDER):
            c = np.full(len(chars), _SPACE, np.int64)
            c[k:] = chars[:-k]
            c[pos < k] = _SPACE
            prior.append(c)
        high.append((prior[4] << 21 | prior[3])[known:])
        low.append((prior[2] << 42 | prior[1] << 21 | prior[0])[known:])
    pairs = np.stack([np.concatenate(high), np.concatenate(low)], axis=1)
    u, n = np.unique(pairs, axis=0, return_counts=True)
    return u[:, 0], u[:, 1], n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", usable: Column | None = None, max_docs: int = MAX_DOCS) -> Model | None:
    """Fit on the rows of ``docs`` that ``usable`` keeps and whose label is not null; None
    if there is none. About ``max_docs`` rows of each language are used (all of those of
    a smaller one), fewer where they are very long or the languages very many."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label"), (usable if usable is not None else F.lit(True)).alias("usable")).filter("usable AND label IS NOT NULL")
    # rows of a repeated or missing id are drawn each by itself
    key = F.coalesce(F.col("id"), F.lit("")), F.xxhash64("text")
    draw = F.pmod(F.xxhash64(*key, F.lit(11)), F.lit(_STEPS))
    sizes = rows.groupBy("label").agg(F.count("*"), F.sum(F.length("text"))).collect()  # one row for each language
    if not sizes:
        return None
    most = min(max_docs, max(1, MAX_TOTAL // len(sizes)))
    limit = F.create_map(*[F.lit(x) for label, n, chars in sizes for x in (label, max(1, int(_STEPS * min(1.0, most / n, MAX_CHARS / max(1, chars or 0)))))])
    chosen = rows.filter(draw < limit[F.col("label")])
    calibrating = F.pmod(F.xxhash64(*key, F.lit(12)), F.lit(5)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label")
            for name in labels.unique().to_pylist():
                mine = batch.filter(pa.compute.equal(labels, name))
                high, low, n = _wide_grams(mine.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(high), pa.array(low), pa.array(n)], names=["label", "high", "low", "n"])

    def counted(rows: DataFrame) -> pa.Table:
        return rows.select("label", "text").mapInArrow(count, "label string, high long, low long, n long").groupBy("label", "high", "low").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample

    got = counted(chosen.filter(~calibrating))
    # a language whose few rows would all calibrate is fitted on them as well
    missing = sorted({r[0] for r in sizes} - set(got.column("label").unique().to_pylist()))
    if missing:
        got = pa.concat_tables([got, counted(chosen.filter(F.col("label").isin(*missing)))])
    if not got.num_rows:
        return None
    label = np.array(got.column("label").to_pylist(), object)
    high, low, n = (got.column(c).to_numpy() for c in ("high", "low", "n"))
    mask = (1 << 21) - 1
    parts = [high >> 21, high & mask, low >> 42, low >> 21 & mask, low & mask]
    seen, where = np.unique(parts[4], return_inverse=True)
    weight = np.bincount(where, weights=n)
    seen, weight = seen[seen != _SPACE], weight[seen != _SPACE]
    letters = np.sort(seen[np.argsort(-weight, kind="stable")][: (1 << BITS) - 2]).astype(np.uint32)
    shell = Model([], letters, [], [], np.zeros(0))
    key = np.zeros(len(n), np.uint64)
    for c in parts:
        key = key << np.uint64(BITS) | shell.identifiers(c.astype(np.uint32))
    model = estimate({name: _summed(key[label == name], n[label == name]) for name in sorted(set(label.tolist()))}, letters)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            labels = batch.column("label").to_pylist()
            for i, _, buf, offsets in text_chunks(batch.column("text"), 1 << 20):
                ce, length, letters_ = model.entropies(buf, offsets)
                out += [(labels[i + t], float(ce[t, model.languages.index(labels[i + t])]), int(length[t])) for t in range(len(length)) if letters_[t] and labels[i + t] in model.languages]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64()))], names=["label", "ce", "n"])

    seen_ce = chosen.filter(calibrating).select("label", "text").mapInArrow(cross, "label string, ce double, n long").toArrow()
    names, ce, length = np.array(seen_ce.column("label").to_pylist(), object), seen_ce.column("ce").to_numpy(), seen_ce.column("n").to_numpy()
    model.limits = np.array([calibrate(ce[names == name], length[names == name]) for name in model.languages])
    return model


def calibrate(ce: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Mean cross-entropy and what a text may exceed it by, besides its allowance for
    being short; a language without calibration texts rejects nothing."""
    if not len(ce):
        return 0.0, float("inf")
    mean = float(np.average(ce, weights=n))
    over = ce - mean - SHORT / np.sqrt(np.maximum(n, 1))
    return mean, max(0.0, float(np.quantile(over, 0.999))) + SLACK


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, score, rejected``.

    A text that is null or has no letter is ``und``, score 0 and rejected; without a
    model every text is. ``score`` (0 to 1) compares the best language with the others.
    Repeated rows are judged alike. Columns of ``docs`` with the new names give way to them.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col))
            out = []
            if model is None:
                out = [(UNKNOWN_LANGUAGE, 0.0, True)] * batch.num_rows
            else:
                for _, _, buf, offsets in text_chunks(column, 1 << 19):
                    out += model.judge(buf, offsets)
            add = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *add], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, usable=crc_fold(F.col("doc_id")) != 1)
    held_out = (crc_fold(F.col("doc_id")) == 1).alias("held_out")
    return identify(spread(docs.select("doc_id", held_out, "text")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
