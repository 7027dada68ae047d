"""Results must not depend on how rows fall into partitions and Arrow batches."""

from __future__ import annotations

import numpy as np

from termloom.llm import substring_dedup


def kept_words(texts: dict[int, str], window: int) -> dict[int, tuple[int, str]]:
    """Plain version: a word goes if a window over it stood earlier."""
    seen, out = set(), {}
    for doc in sorted(texts):
        words = texts[doc].split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        out[doc] = (sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def test_substring_dedup_copies_and_overlaps_across_batches(spark):
    """Copies in different batches, and a third text that shares only a passage with them in
    the later copy's batch: the mark of several blocks comes from the later copy alone."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    first, second = [], []
    for k in range(0, 600, 10):
        x, length = fresh(60), int(rng.integers(20, 30))
        at = int(rng.integers(0, 60 - length))
        first.append((k + 1, " ".join(x)))
        second += [(k + 5, " ".join(x)), (k + 6, " ".join([*fresh(15), *x[at : at + length], *fresh(15)]))]
    parts = spark.sparkContext.parallelize([first, second], 2).flatMap(lambda rows: rows)  # one partition each
    docs = spark.createDataFrame(parts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == kept_words(dict(first + second), substring_dedup.WINDOW)
