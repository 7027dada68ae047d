"""Words, word hashes and Arrow plumbing shared by the operators of this package.

A *word* is a maximal run of bytes other than space and 0x09-0x0D; since those
are all ASCII, splitting the UTF-8 bytes equals splitting the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once by the vectorised kernels; bounds a worker's memory.
CHUNK_BYTES = 3 << 20
#: Text bytes hashed at once: what that needs stays in a core's cache.
HASH_BYTES = 1 << 18
#: Rows in an Arrow batch, unless the session sets its own number.
BATCH_ROWS = 2000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Random values of the bytes, for two word hashes that have nothing in common.
_TABLES = np.random.Generator(np.random.PCG64(20260101)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch unless the session already does."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def word_count(text: Column) -> Column:
    """Words of a text, without Python; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns cannot matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def run(b: int) -> np.ndarray:
                out = np.empty(n, np.uint64)
                out[0] = 1
                size = 1
                with np.errstate(over="ignore"):
                    while size < n:
                        step = min(size, n - size)
                        out[size : size + step] = out[:step] * np.uint64(pow(b, size, 1 << 64))
                        size += step
                return out

            self.up, self.down = run(self.base), run(self.inverse)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = (Powers(_BASE | 1), Powers(0xC2B2AE3D27D4EB4F)), Powers(0xD6E8FEB86659FD93)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end: text t is
    ``buf[offsets[t]:offsets[t + 1]]``, and no word crosses from one to the next."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    return starts, np.flatnonzero(word & ~after) + 1


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """A 64-bit hash for each word, by polynomial prefix sums over the bytes; ``kind`` 0 and 1
    are independent of each other."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            up, down = _BYTE_POWERS[kind].get(hi - lo + 1)
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_TABLES[kind][buf[lo:hi]] * up[: hi - lo], out=sums[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            i = j
    return out


class Sequence:
    """Hashes of any run of a word-hash array in constant time."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = _WORD_POWERS.get(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(words * self.up[: len(words)], out=self.sums[1:])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length).astype(np.uint64))


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``max_bytes`` (one row at
    least): (first row, row after the last, bytes, offsets). Null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def as_int64(column: pa.Array, null: int = np.iinfo(np.int64).max) -> np.ndarray:
    """Ids as int64; null becomes the largest value."""
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)
