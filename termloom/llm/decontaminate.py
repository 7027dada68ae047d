"""Benchmark decontamination by latent semantic retrieval.

1. Texts become sequences of identifiers of the benchmark's words (others are 0).
2. Passages of 32 words give document frequencies and a sketch of their TF-IDF Gram
   matrix: every task multiplies its passages by a random matrix and back, and the
   sums over tasks yield the leading right singular vectors (randomised SVD in one
   pass over all passages). One basis serves all items.
3. Passages (32 words, every 16) whose latent cosine to a benchmark passage reaches
   ``cosine`` times what an exact copy keeps of it, filled up with other words, are
   candidates. So is every passage near which enough of an item's words stand in any order
   that the check below might accept it: the cosine alone loses copies with replaced words.
4. A candidate's surroundings must hold the item as a common subsequence: ``sure`` of
   its words, or ``likely`` of them with the answer (its own column, or the item's
   closing words) as well. Items of fewer than ``MIN_WORDS`` words, too short for that,
   are found where their words stand one after the other.

The search goes through the items in blocks of bounded size; the latent space has
``FEATURES`` dimensions at most before its rank is cut (beyond it words share them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import hash_words, mix, small_batches, text_chunks, word_bounds
from termloom.llm.language_id import HashedRows
from termloom.session import shuffle_partitions, spread, staged, tidy

PASSAGE, STRIDE = 32, 16
#: ``COSINE`` is asked of a passage that holds as much else as an item of its length must bear.
RANK, OVERSAMPLE, COSINE = 256, 8, 0.72
SURE, LIKELY, ANSWER, ANSWER_WORDS, MIN_WORDS = 0.8, 0.6, 0.5, 5, 5
#: Items and words of a block of the search, at most; share of passages that makes a word common.
BLOCK_ITEMS, BLOCK_WORDS, COMMON = 2000, 50_000, 0.1
#: Share of passages that makes a word one that the bound takes to be there.
FEATURES, GIVEN = 1 << 14, 0.05
_ROWS, _TERM_BLOCK = 4_000_000, 256
#: Sums made at once; they stay in a core's cache.
_SUM_BYTES = 1 << 18


def _plain_table() -> np.ndarray:
    """Letters, digits and bytes beyond ASCII as they are, the rest to spaces."""
    return np.array([i if i >= 128 or chr(i).isalnum() else 0x20 for i in range(256)], np.uint8)


_PLAIN = _plain_table()


def _alone(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the characters of scripts written without blanks (U+3000 to U+9FFF, U+20000
    on, Thai, Lao, Burmese, Khmer) and the byte after each."""
    at = np.flatnonzero((buf >= 0xE0) & (buf != 0xFF))
    lead, second = buf[at], buf[np.minimum(at + 1, len(buf) - 1)]
    three = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (lead == 0xE1) & ((second <= 0x82) | (second == 0x9E) | (second == 0x9F))
    four = (lead == 0xF0) & (second >= 0xA0)
    keep = three | four
    return at[keep], at[keep] + np.where(four[keep], 4, 3)


def plain_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain words of texts laid end to end, and each text's first word. A
    character of a script without blanks is a word of its own."""
    buf = _PLAIN[buf]
    wide = len(buf) > 0 and int(buf.max()) >= 0xE0
    if wide:
        mark = np.flatnonzero((buf[:-2] == 0xE3) & (buf[1:-1] == 0x80))  # ideographic punctuation
        buf[(mark[:, None] + np.arange(3)).ravel()] = 0x20
    starts, ends = word_bounds(buf, offsets)
    if wide:
        lone, after = _alone(buf)
        every = np.union1d(starts, np.concatenate([lone, after]))
        of = np.searchsorted(starts, every, "right") - 1
        inside = (of >= 0) & (every < ends[np.maximum(of, 0)])
        every, of = every[inside], of[inside]
        starts, ends = every, np.minimum(ends[of], np.append(every[1:], len(buf)))
    return hash_words(buf, starts, ends), np.searchsorted(starts, offsets)


@dataclass
class Words:
    """The benchmark's words and their identifiers (from 1 on)."""

    table: HashedRows
    size: int  # identifiers
    room: int  # latent features, at most

    @property
    def kind(self) -> type:
        return np.uint16 if self.size < 65_535 else np.int32

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        row = self.table.find(hashes)
        return np.where(row >= 0, self.table.values[np.maximum(row, 0), 0], 0).astype(np.int32) if self.size else np.zeros(len(hashes), np.int32)

    @property
    def features(self) -> np.ndarray:
        """The latent feature of each identifier: itself, or if there are too many one of ``room``."""
        ids = np.arange(self.size + 1)
        return ids if self.size <= self.room else np.concatenate(([0], 1 + mix(ids[1:].astype(np.uint64)) % np.uint64(self.room))).astype(np.int64)


@dataclass
class Items:
    """A block of benchmark items as sequences of identifiers."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    short: dict[int, tuple[np.ndarray, list[int]]]  # by number of words: sequences, item of each


def _of(text: str | None) -> np.ndarray:
    _, _, buf, offsets = next(text_chunks(pc.utf8_lower(pa.array([text], pa.string()))))
    return plain_words(buf, offsets)[0]


def make_words(hashes: list[np.ndarray]) -> Words:
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    return Words(HashedRows(terms, np.arange(1, len(terms) + 1, dtype=np.float64)[:, None]), len(terms), FEATURES)


def make_items(rows: list[tuple[int, np.ndarray, np.ndarray]], words: Words) -> Items:
    """``rows``: item, word hashes of its text and of its answer. An item without a word
    cannot be found."""
    coded = [(i, words.lookup(t), words.lookup(a)) for i, t, a in rows if len(t)]
    long = [c for c in coded if len(c[1]) >= MIN_WORDS]
    short = {n: [c for c in coded if len(c[1]) == n] for n in range(1, MIN_WORDS)}
    return Items(
        [c[0] for c in long], [c[1] for c in long], [a if len(a) else w[-ANSWER_WORDS:] for _, w, a in long],
        {n: (np.stack([c[1] for c in some]), [c[0] for c in some]) for n, some in short.items() if some},
    )


def find_short(ids: np.ndarray, offsets: np.ndarray, short: dict) -> Iterator[tuple[int, int]]:
    """(text, item) wherever a short item's words stand one after the other."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n, (sequences, items) in short.items():
        if len(ids) < n:
            continue
        keys = _packed(sequences.T)
        order = np.argsort(keys, kind="stable")
        runs = _packed([ids[k : len(ids) - n + 1 + k] for k in range(n)])
        lo, hi = np.searchsorted(keys[order], runs, "left"), np.searchsorted(keys[order], runs, "right")
        ok = np.flatnonzero((hi > lo) & (text[: len(runs)] == text[n - 1 :]) & (ids[: len(runs)] > 0))
        for at in ok.tolist():
            for k in order[lo[at] : hi[at]].tolist():
                if (sequences[k] == ids[at : at + n]).all():
                    yield int(text[at]), items[k]


def _packed(columns) -> np.ndarray:
    """One 64-bit key for each row of columns of identifiers."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key + c.astype(np.uint64) + np.uint64(1))
    return key


def _encode(docs: DataFrame, words, kind: str) -> DataFrame:
    """``(uid, id, ids)``: each text as packed identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Words = words.value
        for batch in batches:
            out = []
            for _, _, buf, offsets in text_chunks(pc.utf8_lower(batch.column("text"))):
                hashes, first = plain_words(buf, offsets)
                ids = known.lookup(hashes).astype(known.kind)
                out += [ids[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), pa.array(out, pa.binary())], names=["uid", "id", "ids"])

    return docs.mapInArrow(run, f"uid long, id {kind}, ids binary")


def _laid(column: pa.Array, kind: type, most: int = 100_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, identifiers end to end, offsets) for runs of rows of about ``most`` words."""
    raw, i = [np.frombuffer(x.as_buffer(), kind) for x in column], 0
    while i < len(raw):
        j, n = i, 0
        while j < len(raw) and (j == i or n + len(raw[j]) <= most):
            n += len(raw[j])
            j += 1
        yield i, np.concatenate(raw[i:j]).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in raw[i:j]])))
        i = j


def _cells(offsets: np.ndarray, length: int, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each word when texts are cut every ``length`` words, and each text's first cell."""
    n = np.diff(offsets)
    first = np.concatenate(([0], np.cumsum(-(-n // length) + pad)))
    pos = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
    return np.repeat(first[:-1], n) + pos // length, first


def _distinct(cell: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (cell, identifier) pairs of known words, by cell."""
    known = ids > 0
    pairs = np.unique(_small(cell[known] * (size + 1) + ids[known])).astype(np.int64)
    cell = pairs // (size + 1)
    return cell, pairs - cell * (size + 1)


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers of zero or more in the narrowest type that holds them: it sorts much faster."""
    top = int(x.max(initial=0))
    return x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def group_sums(rows: np.ndarray, which: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of ``rows[which]`` over groups that begin at ``heads``, adding the k-th member of
    many groups at once (numpy's reduceat is several times slower along rows). Groups go by
    falling size, so those that have a k-th member are the first ones, as many at once as
    stay in a core's cache. Each group is added up in its own order."""
    counts = np.diff(np.append(heads, len(which)))
    order = np.argsort(-counts, kind="stable")
    out = np.empty((len(heads), rows.shape[1]), rows.dtype)
    block = max(1, _SUM_BYTES // max(1, rows.shape[1] * rows.itemsize))
    room = np.empty((min(block, len(heads)), rows.shape[1]), rows.dtype)
    for a in range(0, len(order), block):
        some = order[a : a + block]
        at, n = heads[some], counts[some]
        sums = rows[which[at]]
        for k, left in enumerate(np.searchsorted(-n, -np.arange(2, n[0] + 1), "right").tolist(), 1):
            np.take(rows, which[at[:left] + k], axis=0, out=room[:left], mode="clip")  # other modes copy once more
            sums[:left] += room[:left]
        out[some] = sums
    return out


def document_frequencies(encoded: DataFrame, words) -> tuple[np.ndarray, int]:
    """In how many passages each latent feature stands, and the number of passages."""
    size = int(words.value.features.max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Words = words.value
        fold, counts = known.features, np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, ids, offsets in _laid(batch.column("ids"), known.kind):
                cell, first = _cells(offsets, PASSAGE)
                counts[0] += first[-1]
                counts += np.bincount(_distinct(cell, fold[ids], size)[1], minlength=size + 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "n"])

    out = np.zeros(size + 1, np.int64)
    for term, n in encoded.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # FEATURES rows at most
        out[term] = n
    return out[1:], int(out[0])


def weights_of(df: np.ndarray, passages: int, items: list[np.ndarray]) -> np.ndarray:
    """Inverse document frequency of each feature (index 0: none). Very common ones weigh
    nothing, unless one of the ``items`` (as features) has hardly any other."""
    idf = np.log((passages + 1) / (df + 0.5))
    rare = (df > 0) & (df <= COMMON * passages)
    keep = rare.copy()
    for w in items:
        if rare[w - 1].sum() < 4:
            keep[w - 1] |= df[w - 1] > 0
    return np.concatenate(([0.0], np.where(keep, np.maximum(idf, 0.1), 0.0)))


def latent_basis(encoded: DataFrame, words, weights: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors (features x rank) of the TF-IDF passages, by the
    Nystroem form of the randomised SVD of their Gram matrix."""
    size = len(weights) - 1
    width = min(size, rank + OVERSAMPLE)
    omega = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((weights.astype(np.float32), omega.astype(np.float32)))
    blocks = -(-size // _TERM_BLOCK)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Words = words.value
        fold = known.features
        w, om = shared.value
        scaled = np.vstack([np.zeros((1, width), np.float32), om * w[1:, None]])
        total = np.zeros((size + 1, width), np.float64)
        for batch in batches:
            for _, ids, offsets in _laid(batch.column("ids"), known.kind):
                cell, _ = _cells(offsets, PASSAGE)
                ids = fold[ids]
                ids = np.where(w[ids] > 0, ids, 0)
                cell, term = _distinct(cell, ids, size)
                if not len(cell):
                    continue
                heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                norm2 = np.add.reduceat(w[term] ** 2, heads)
                y = group_sums(scaled, term, heads) / norm2[:, None].astype(np.float32)  # both factors of the norm
                row = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(cell))))
                order = np.argsort(_small(term), kind="stable")
                t = term[order]
                th = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                total[t[th]] += group_sums(y, row[order], th) * w[t[th], None]
        for b in range(blocks):
            part = total[1 + b * _TERM_BLOCK : 1 + (b + 1) * _TERM_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.float32).astype(np.float64)
                sums[b] = sums[b] + x if b in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "sums"])

    parts = min(shuffle_partitions(spark), blocks)
    sketch = np.zeros((size, width))
    for b, raw in encoded.select("ids").mapInArrow(send, "block int, sums binary").repartition(parts, "block").mapInArrow(add, "block int, sums binary").collect():  # identifiers x rank numbers
        sketch[b * _TERM_BLOCK : (b + 1) * _TERM_BLOCK] = np.frombuffer(raw, np.float64).reshape(-1, width)
    shift = 1e-6 * max(np.linalg.norm(sketch), 1e-12)
    sketch = sketch + shift * omega
    core = omega.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, shift * 1e-3)
    left = sketch @ (vectors / np.sqrt(values))
    u, _, _ = np.linalg.svd(left, full_matrices=False)
    return u[:, : min(rank, width)]


def item_passages(words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(item, identifiers) of the passages that stand for the items."""
    of, parts = [], []
    for k, w in enumerate(words):
        for a in range(0, max(1, len(w) - STRIDE), STRIDE):
            of.append(k)
            parts.append(w[a : a + PASSAGE])
    return np.array(of, np.int64), parts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_subsequence(pattern: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one integer operation for each word of the text."""
    return Pattern(pattern).in_common(text)


class Pattern:
    """A sequence to be held against many texts."""

    def __init__(self, words: np.ndarray):
        self.distinct, place, self.counts = np.unique(words, return_inverse=True, return_counts=True)
        self.size, self.masks = len(words), [0] * len(self.distinct)
        for i, x in enumerate(place.tolist()):
            self.masks[x] |= 1 << i

    def places(self, text: np.ndarray) -> np.ndarray:
        """The text's words that the pattern has, as places among its distinct words."""
        at = np.searchsorted(self.distinct, text)
        at[at == len(self.distinct)] = 0
        return at[self.distinct[at] == text] if len(self.distinct) else at[:0]

    def most(self, places: np.ndarray) -> int:
        """Words in common in any order: no subsequence is longer."""
        return int(np.minimum(np.bincount(places, minlength=len(self.counts)), self.counts).sum())

    def subsequence(self, places: np.ndarray) -> int:
        v = full = (1 << self.size) - 1
        for x in places.tolist():
            u = v & self.masks[x]
            v = ((v + u) | (v - u)) & full
        return self.size - v.bit_count()

    def in_common(self, text: np.ndarray) -> int:
        return self.subsequence(self.places(text))


def verdict(item: Pattern, answer: Pattern, near: np.ndarray, sure: float, likely: float) -> float | None:
    """The share of the item found in order near a candidate, if that is enough."""
    places = item.places(near)
    if item.most(places) < min(sure, likely) * item.size:
        return None
    share = item.subsequence(places) / item.size
    if share >= sure or share >= likely and answer.in_common(near) >= ANSWER * answer.size:
        return share
    return None


def word_needs(items: list[np.ndarray], common: np.ndarray, least: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What any text must hold, in any order, that has ``least`` of an item: (reach, items, how
    often each has a word, words needed) by the items' reach, the cells (of ``STRIDE`` words)
    that may belong to them on either side of a passage; reaches are rounded up in pairs.
    ``common`` marks words taken to be there: an item needs so many fewer of the others, and
    only where that leaves it too few are its common words counted like any."""
    need = np.array([int(np.ceil(least * len(w) - 1e-9)) for w in items], np.int64)
    rest = need - np.array([common[w].sum() for w in items], np.int64)
    given = rest >= np.maximum(4, 0.3 * need)
    reach = -(-np.array([len(w) for w in items], np.int64) // STRIDE)
    reach += reach % 2
    out = []
    for r, without in sorted({(int(r), bool(g)) for r, g in zip(reach, given, strict=True)}):
        mine = np.flatnonzero((reach == r) & (given == without))
        # no sum exceeds an item's length
        times = np.zeros((len(common), len(mine)), np.int8 if r * STRIDE < 128 else np.int32)
        for column, k in enumerate(mine.tolist()):
            words, counts = np.unique(items[k], return_counts=True)
            times[words, column] = np.where(common[words] & without, 0, counts)
        out.append((r, mine, times, rest[mine] if without else need[mine]))
    return out


def possible(words: np.ndarray, cell: np.ndarray, first: np.ndarray, needs: list) -> np.ndarray:
    """(cell, item) wherever the surroundings of the passage that begins there hold enough
    words of the item, a word that stands there counting as often as the item has it.
    ``first``: each text's first cell."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[cell]
    order = np.argsort(_small(text * (int(words.max(initial=0)) + 1) + words), kind="stable")  # cells ascend already
    words, cell, text = words[order], cell[order], text[order]
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    low, high, out = first[text], first[text + 1] - 2, [np.zeros((0, 2), np.int64)]
    for reach, items, times, need in needs:
        # the word is within reach of the passages from begin to stop, left out where it is already
        begin, stop = np.maximum(low, cell - reach - 1), np.minimum(high, cell + reach) + 1
        begin[again] = np.maximum(begin[again], stop[np.flatnonzero(again) - 1])
        some = np.flatnonzero((begin < stop) & times.any(axis=1)[words])
        counts = np.zeros((int(first[-1]) + 1, len(items)), times.dtype)
        for sign, at in ((1, begin[some]), (-1, stop[some])):
            order = np.argsort(_small(at), kind="stable")
            at = at[order]
            heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
            counts[at[heads]] += sign * group_sums(times, words[some[order]], heads)
        p, q = np.nonzero(np.cumsum(counts, axis=0, dtype=np.int32) >= need)
        out.append(np.stack([p, items[q]], axis=1))
    return np.concatenate(out)


def search(encoded: DataFrame, words, items: Items, weights: np.ndarray, basis: np.ndarray, common: np.ndarray, cosine: float, sure: float, likely: float) -> DataFrame:
    """``(uid, item_ids, coverage)`` of every row in which an item of the block is found.
    ``common`` marks identifiers that very many passages have."""
    spark, fold = encoded.sparkSession, words.value.features
    rows = np.vstack([np.zeros((1, basis.shape[1])), basis * weights[1:, None]]).astype(np.float32)
    of, parts = item_passages(items.words)
    queries = _unit(np.stack([rows[fold[p]].sum(axis=0) for p in parts])) if parts else np.zeros((0, basis.shape[1]), np.float32)
    aligned = 0.75 * PASSAGE  # words of a long item that some passage holds, however the item lies
    limits = cosine * np.sqrt(np.minimum([len(p) for p in parts], aligned) / PASSAGE)
    queries = (queries / limits[:, None]).astype(np.float32) if parts else queries
    own = np.unique(np.concatenate([np.zeros(0, np.int32), *items.words]))  # the block's own words, numbered from 1
    local = [np.searchsorted(own, w) + 1 for w in items.words]
    needs = word_needs(local, np.concatenate(([False], common[own])), min(sure, likely))
    shared = spark.sparkContext.broadcast((rows, queries, of, own, needs, items))  # bounded by FEATURES and the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Words = words.value
        rows, queries, of, own, needs, items = shared.value
        fold, numbers = known.features, np.zeros(known.size + 1, np.int64)
        numbers[own] = np.arange(1, len(own) + 1)
        patterns, answers = [Pattern(w) for w in items.words], [Pattern(a) for a in items.answers]
        loaded = np.any(rows != 0, axis=1)
        step = max(1, _ROWS // max(1, len(queries)))
        for batch in batches:
            found: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
            for i, ids, offsets in _laid(batch.column("ids"), known.kind):
                if not ids.any():
                    continue
                for t, item in find_short(ids, offsets, items.short):
                    found[i + t][item] = 1.0
                if not len(queries):
                    continue
                cell, first = _cells(offsets, STRIDE, pad=1)
                sums = np.zeros((first[-1], rows.shape[1]), np.float32)
                features = fold[ids]
                use = np.flatnonzero(loaded[features])
                if len(use):
                    c = cell[use]
                    heads = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                    sums[c[heads]] = group_sums(rows, features[use], heads)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                passages = sums[:-1] + sums[1:]
                length = np.sqrt(np.einsum("ij,ij->i", passages, passages))
                good = np.flatnonzero((text[1:] == text[:-1]) & (length > 0))
                mine = numbers[ids]
                use = np.flatnonzero(mine > 0)
                hits = [possible(mine[use], cell[use], first, needs)]
                for a in range(0, len(good), step):
                    at = good[a : a + step]
                    likeness = passages[at] @ queries.T  # queries are divided by their limits
                    some = np.flatnonzero(likeness.max(axis=1) >= length[at])
                    p, q = np.nonzero(likeness[some] >= length[at[some], None])
                    hits.append(np.stack([at[some[p]], of[q]], axis=1))
                hits = np.unique(np.concatenate(hits), axis=0)
                for at, k in hits.tolist():
                    t = int(text[at])
                    item = patterns[k]
                    here = int(offsets[t]) + (at - int(first[t])) * STRIDE
                    lo, hi = max(int(offsets[t]), here - item.size), min(int(offsets[t + 1]), here + PASSAGE + item.size)
                    share = verdict(item, answers[k], ids[lo:hi], sure, likely)
                    if share is not None:
                        mine_ = found[i + t]
                        mine_[items.ids[k]] = max(share, mine_.get(items.ids[k], 0.0))
            some = [k for k, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(pa.array(some, pa.int64())), pa.array([sorted(found[k]) for k in some], pa.list_(pa.int64())), pa.array([max(found[k].values()) for k in some], pa.float64())],
                names=["uid", "item_ids", "coverage"],
            )

    return encoded.select("uid", "ids").mapInArrow(run, "uid long, item_ids array<long>, coverage double")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = COSINE, sure: float = SURE, likely: float = LIKELY, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, contaminated, item_ids, coverage``.

    ``benchmark`` has ``item_id, text`` and perhaps ``answer``. ``item_ids`` (sorted) are
    the items found, ``coverage`` the largest share of one. Words are compared in lower
    case without punctuation; characters of scripts without blanks are words. Null text:
    not contaminated. Items that are null or have no word are not looked for; those of
    fewer than ``MIN_WORDS`` words are found as they stand; repeated items count once.
    Repeated rows and null or shared ids are judged by themselves; extra columns are
    ignored. The result does not depend on the size of the blocks.

    The benchmark's words (12 bytes each) are held by every task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"), answer.alias("answer")).dropna(subset=["item_id", "text"]).distinct()
    hashed = [(i, _of(t), _of(a)) for i, t, a in sorted(((r[0], r[1], r[2]) for r in asked.toLocalIterator()), key=lambda r: (r[0], r[1], r[2] or ""))]
    words = spark.sparkContext.broadcast(make_words([x for h in hashed for x in h[1:]]))
    encoded = staged(_encode(table, words, dict(docs.dtypes)[id_col]), "identifiers")
    blocks, room = [], (0, 0)
    for h in hashed:
        if not blocks or room[0] < 1 or room[1] < len(h[1]):
            blocks.append([])
            room = (block_items, block_words)
        blocks[-1].append(h)
        room = (room[0] - 1, room[1] - len(h[1]))
    items = [make_items(b, words.value) for b in blocks]
    fold = words.value.features
    df, passages = document_frequencies(encoded, words)
    weights = weights_of(df, passages, [fold[w] for b in items for w in b.words])
    basis = latent_basis(encoded, words, weights) if len(df) and passages else np.zeros((len(df), 1))
    common = np.concatenate(([False], df > GIVEN * passages))[fold]
    tidy(spark)  # of the sketch's jobs
    found = None
    for b in items:
        some = search(encoded, words, b, weights, basis, common, cosine, sure, likely)
        found = some if found is None else found.unionByName(some)
    rows = encoded.select("uid", F.col("id").alias(id_col))
    if found is None:
        return rows.select(id_col, F.lit(False).alias("contaminated"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("coverage"))
    hits = found.groupBy("uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("coverage").alias("coverage"))
    none = F.array().cast("array<long>")
    return rows.join(hits, "uid", "left").select(id_col, F.col("coverage").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(spread(docs), benchmark)
