"""Token counts by overlap resynchronisation.

A text of more than ``chunk`` characters is encoded in overlapping chunks, each with the
offsets of its tokens; two neighbours are spliced at a boundary that both have, that is
proven stable and after which they agree. Offsets are sums of the tokens' lengths in bytes:
a byte-level tokenizer that knows every byte loses none, and the library is much faster
when it need not make them. Where an overlap holds no such boundary it is
widened, and where that reaches what is settled already, the chunk before it is lengthened.

Why a boundary is stable: the byte-level pattern's matches that hold a non-blank
character hold a blank one only as their first, so a match always ends where a
blank follows a non-blank, whatever stands left of it; matching then goes on from
there alone. Added tokens hold no blank and lie on one side of it. So left of such a
place the left chunk has the text's own tokens, and right of it the right chunk has.
Tokenizers of any other build are asked for whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import small_batches
from termloom.session import spread

CHUNK, OVERLAP, LIMIT = 4096, 128, 512
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A place where a blank follows a non-blank.
_STABLE = re.compile(f"(?<=[^{_BLANK}])(?=[{_BLANK}])")
#: How a byte-level vocabulary writes each byte.
_SYMBOLS = {chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))} | {chr(0x100 + k) for k in range(256 - 188)}
_LOADED: dict = {}


class Counter:
    """Counts tokens of texts as the library's tokenizer at ``path`` gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splits = self.proven(spec)
        self.lengths = token_lengths(spec) if self.splits else []

    @staticmethod
    def proven(spec: dict) -> bool:
        """Whether blank boundaries are stable, and tokens as long as their bytes, for a
        tokenizer of this build."""
        pre = spec.get("pre_tokenizer") or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{_BLANK}]", t["content"])) for t in spec.get("added_tokens") or [])
        model = spec.get("model") or {}
        exact = not (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")) and _SYMBOLS <= set(model.get("vocab") or {})
        return bool(spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and plain and model.get("type") == "BPE" and not model.get("dropout") and exact)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False)) if text else 0

    def encoded(self, text: str, start: int, stop: int) -> Encoded:
        return Encoded(self.tokenizer.encode_batch_fast([text[start:stop]], add_special_tokens=False)[0], self.lengths)

    def spliced(self, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
        """(tokens of a text, chunks it was encoded in)."""
        total, settled, chunks = 0, 0, 1  # tokens and characters left of the last splice
        stop = min(len(text), size)
        left, before = self.encoded(text, 0, stop), 0  # tokens of ``left`` that lie before the splice
        while stop < len(text):
            wide = max(1, min(overlap, size - 1))
            until = min(len(text), stop - wide + size)
            while (begin := stop - wide) > settled:
                right, chunks = self.encoded(text, begin, until), chunks + 1
                if (ends := common_boundary(text, left, right, begin, stop)) is not None:
                    break
                wide *= 2
            else:  # the overlap would reach beyond what is settled
                stop = min(len(text), settled + 2 * (stop - settled))
                left, before, chunks = self.encoded(text, settled, stop), 0, chunks + 1
                continue
            settled, mine, after = ends
            total += mine - before
            left, before, stop = right, after, until
        return total + len(left) - before, chunks

    def counts(self, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
        """(tokens, chunks) of each text."""
        long = {i for i, t in enumerate(texts) if t and len(t) > chunk and self.splits}
        once = self.tokenizer.encode_batch_fast(["" if i in long else t or "" for i, t in enumerate(texts)], add_special_tokens=False)
        return [self.spliced(texts[i], chunk, overlap) if i in long else (len(e), 1) for i, e in enumerate(once)]


class Encoded:
    """The tokens of one chunk by their offsets from its begin or its end."""

    def __init__(self, encoding, lengths: list[int]):
        self.encoding, self.lengths = encoding, lengths

    def __len__(self) -> int:
        return len(self.encoding)

    @cached_property
    def ids(self) -> list[int]:
        return self.encoding.ids

    def until(self, head: str) -> int | None:
        """Tokens of what the chunk begins with; None if one lies across its end."""
        return self.reach(self.ids, head)

    def before(self, tail: str) -> int | None:
        """Tokens before what the chunk ends with; None if one lies across its begin."""
        n = self.reach(reversed(self.ids), tail)
        return n if n is None else len(self) - n

    def reach(self, ids: Iterable[int], text: str) -> int | None:
        rest = len(text.encode())
        for n, i in enumerate(ids, 1):
            rest -= self.lengths[i]
            if rest <= 0:
                return None if rest else n


def common_boundary(text: str, left: Encoded, right: Encoded, begin: int, stop: int) -> tuple[int, int, int] | None:
    """(place, tokens of ``left`` and of ``right`` before it): a stable place inside (begin,
    stop) where both chunks end a token and from which on they agree up to the last one."""
    places = [m.start() for m in _STABLE.finditer(text, begin + 1, stop)]
    if not places:
        return None
    cut, last = places[len(places) // 2], places[-1]
    a, b, c, d = left.before(text[cut:stop]), right.until(text[begin:cut]), left.before(text[last:stop]), right.until(text[begin:last])
    if None in (a, b, c, d) or left.ids[a:c] != right.ids[b:d]:
        return None
    return cut, a, b


def token_lengths(spec: dict) -> list[int]:
    """Bytes of each token of a byte-level vocabulary, which has a character for each byte."""
    lengths = {i: len(t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens") or []}
    return [lengths.get(i, 0) for i in range(max(lengths) + 1)]


def counter(path: str) -> Counter:
    """The worker's counter for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit, n_chunks``.

    No begin, end or template tokens; special strings inside a text count as the
    library takes them by default. ``n_chunks`` is the number of chunks that were encoded
    (1: the text was not longer than ``chunk`` characters, or the tokenizer has no proven
    boundaries). Null text counts as empty (0 tokens); null and repeated ids keep their
    rows; extra columns are ignored. ``tokenizer_path`` must exist on every executor.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                n = count.counts(part.column("text").to_pylist(), chunk, overlap)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array([k for k, _ in n], pa.int64()), pa.array([k for _, k in n], pa.int64())], names=["id", "n_bytes", "n_tokens", "n_chunks"])

    text = F.col(f"`{text_col}`")
    table = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    out = table.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, n_chunks long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path("byte_bpe_50k.json"))
