"""Each operator against a plain version of its contract."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import tracemalloc
import zlib
from fractions import Fraction
from itertools import accumulate
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termloom.llm import decontaminate, jpeg, language_id, media, mixing, quality, queries, simhash, substring_dedup, token_counts, warc
from termloom.llm.common import crc_fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    from conftest import DATA

    if not DATA.exists():
        pytest.skip("the driver's tables are not here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(same_as_sql, name):
    same_as_sql(name)


def components(ids, linked):
    label = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                again = True
    return label


def random_docs(rng, n, vocabulary=12, longest=60):
    pool = [" ".join(f"w{k}" for k in rng.integers(0, vocabulary, rng.integers(0, longest))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        a, b = pool[rng.integers(len(pool))], pool[rng.integers(len(pool))]
        out.append(a + (" \n" if rng.random() < 0.5 else " ") + b)
    return out


def test_substring_dedup(spark):
    rng = np.random.default_rng(5)
    docs = random_docs(rng, 90) + [" ".join(["tick"] * 70), " ".join(["tick", "tock"] * 40)]
    window = 20
    seen, gone = {}, {}
    words = [WORD.findall(t) for t in docs]
    for i, w in enumerate(words):
        gone[i] = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[i].update(range(s, s + window))
            else:
                seen[key] = i
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(7)
    out = substring_dedup.dedup_substrings(df).collect()
    assert len(out) == len(docs)
    for r in out:
        i = r["doc_id"]
        assert (r["n_words"], r["n_removed"]) == (len(words[i]), len(gone[i]))
        assert r["kept_text"] == " ".join(w for k, w in enumerate(words[i]) if k not in gone[i])
        covered = set()
        for f in r["factors"]:
            assert f["length"] >= window and (f["ref_doc"], f["ref_start"]) < (i, f["start"])
            assert words[i][f["start"] : f["start"] + f["length"]] == words[f["ref_doc"]][f["ref_start"] : f["ref_start"] + f["length"]]
            covered.update(range(f["start"], f["start"] + f["length"]))
        assert covered == gone[i]


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints(documents, texts):
    out = simhash.near_duplicates(documents).collect()
    assert all(int(r["fingerprint"], 16) == plain_fingerprint(texts[r["doc_id"]]) for r in out)


@pytest.mark.parametrize("segments,block", [(7, 512), (5, 4), (8, 3)])
def test_pigeonring_loses_no_link(spark, segments, block):
    rng = np.random.default_rng(segments)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for b in base.tolist():
        for _ in range(14):
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                b ^= 1 << bit
            fps.add(b)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, rep long")
    found = [(r["a"], r["b"]) for r in simhash.link_edges(df, segments, block=block).collect()]
    truth = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert components(range(len(fps)), found) == components(range(len(fps)), truth)
    assert len(truth) > 50


def test_token_counts_agree_with_the_library():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    c = token_counts.Counter(path)
    rng = np.random.default_rng(2)
    alphabet = ["a", "b", " ", "  ", "\n", " ", "　", "<|endoftext|>", "'s", "'", "é", "12", "!", "\x1c", "\x85", "日本", "\t", "\U0001f600", "​"]
    assert c.splits
    for _ in range(300):
        s = "".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(0, 60)))
        want = len(c.tokenizer.encode(s, add_special_tokens=False))
        assert c.counts([s]) == [(want, 1)]
        assert {c.spliced(s, size, overlap)[0] for size, overlap in ((8, 2), (16, 5), (5, 1), (30, 29))} == {want}
    huge = "x" * 150_000
    assert c.counts([huge])[0][0] == c.whole(huge)
    other = token_counts.Counter(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    assert not other.splits and other.counts(["Hello  World" * 900]) == [(other.whole("Hello  World" * 900), 1)]


def test_token_offsets_are_sums_of_lengths():
    """Chunks are spliced without the library's offsets, which the lengths give as well."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    c = token_counts.Counter(path)
    s = "".join(f" na\u00efve {i} \u65e5\u672c\U0001f600<|endoftext|>it's\u200b\t{'x' * (i % 9)}\x00\n" for i in range(400))
    whole = c.tokenizer.encode(s, add_special_tokens=False)
    at = np.cumsum([0] + [c.lengths[i] for i in whole.ids])
    byte = np.cumsum([0] + [len(x.encode()) for x in s])  # by character; one of several tokens has the offsets of them all
    assert at[-1] == byte[-1]
    assert all(byte[a] <= p and q <= byte[b] for (a, b), p, q in zip(whole.offsets, at[:-1], at[1:], strict=True))
    c.tokenizer = SimpleNamespace(encode_batch_fast=c.tokenizer.encode_batch_fast)
    count, chunks = c.counts([s])[0]
    assert count == len(whole) and chunks > 1
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    assert token_counts.Counter.proven(spec)
    del spec["model"]["vocab"]["\u00fe"]  # a byte is lost where the vocabulary lacks it
    assert not token_counts.Counter.proven(spec)


def test_token_counts_of_documents(spark, documents):
    """Whole texts against the library; the longer ones are spliced."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    c = token_counts.Counter(path)
    text = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    out = token_counts.count_tokens(documents, path).collect()
    assert all((r["n_tokens"], r["n_bytes"]) == (c.whole(text[r["doc_id"]]), len(text[r["doc_id"]].encode())) for r in out)
    spliced = [r for r in out if r["n_chunks"] > 1]
    assert spliced and all(len(text[r["doc_id"]]) > token_counts.CHUNK for r in spliced)
    assert len(spliced) == sum(len(t) > token_counts.CHUNK for t in text.values())


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = Fraction(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 900))), ["a", "b", "c", None, "é", "z"][min(5, int(rng.exponential(1.2)))]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(df, block_words=100).collect()
    source, sizes = {i: s for i, _, s in rows}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes)
    taken: dict = {}
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(float(want[s]))
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] >= r["size"] * (want[s] // sizes[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(out) == 200 and all(abs(taken[s] - float(want[s])) <= 1 for s in sizes)
    again = mixing.mixed_documents(df.repartition(3), block_words=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_schedule_is_low_discrepancy(spark):
    planned = spark.createDataFrame([(0, "a", 500), (1, "b", 300), (2, "c", 200)], "sid int, source string, slots long")
    rows = sorted((r["slot"], r["sid"], r["rank"]) for r in mixing.schedule(planned).collect())
    assert len(rows) == 1000
    for sid, n in ((0, 500), (1, 300), (2, 200)):
        mine = [r for r in rows if r[1] == sid]
        assert [r[2] for r in mine] == list(range(n))
        run = list(accumulate(1 if r[1] == sid else 0 for r in rows))
        assert max(abs(c - (k + 1) * n / 1000) for k, c in enumerate(run)) < 6


def test_group_sums():
    """Each group is added up in its own order, in little room beside the result."""
    rng = np.random.default_rng(3)
    for width, kind in ((256, np.float32), (3, np.int8), (200_000, np.int8)):
        rows = rng.normal(size=(50, width)).astype(kind)
        counts = np.append(rng.integers(1, 9, 6000 if width < 1000 else 5), 300)
        heads = np.concatenate(([0], np.cumsum(counts)[:-1]))
        which = rng.integers(0, 50, counts.sum())
        tracemalloc.start()
        got = decontaminate.group_sums(rows, which, heads)
        peak = tracemalloc.get_traced_memory()[1] - got.nbytes
        tracemalloc.stop()
        assert got.dtype == rows.dtype
        for g, a, n in zip(got, heads.tolist(), counts.tolist(), strict=True):
            want = rows[which[a]].copy()
            for k in which[a + 1 : a + n].tolist():
                want += rows[k]
            assert (g == want).all()
        assert peak < (1 << 19) + 4 * which.nbytes + 4 * rows[0].nbytes
    none = np.zeros(0, np.int64)
    assert decontaminate.group_sums(rows, none, none).shape == (0, rows.shape[1])


def test_decontamination_finds_planted_and_spares_clean(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(int(rng.integers(15, 60))) for _ in range(20)]
    docs, want = [], {}
    for i in range(160):
        text, k = prose(int(rng.integers(40, 200))), int(rng.integers(20))
        if i % 4 == 0:
            part = items[k].split()
            if i % 8 == 0:  # a paraphrase: an eighth of its words replaced
                for j in range(4, len(part) - 6, 8):
                    part[j] = word()
            at = int(rng.integers(0, 30))
            w = text.split()
            text = " ".join(w[:at] + [p.upper() if i % 3 else p + "," for p in part] + w[at:])
            want[i] = k
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for blocks in (2000, 7):
        got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contamination(df, bench, block_items=blocks).collect()}
        assert len(got) == 160 and {i for i, k in got.items() if k} == set(want)
        assert all(want[i] in got[i] for i in want)


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(1, 6, rng.integers(1, 20)), rng.integers(1, 6, rng.integers(0, 20))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == t[-1, -1]


def test_language_models_are_distributions():
    text = "abra cadabra abracadabra simsalabim"
    letters = np.array(sorted(set(map(ord, text)) - {32}), np.uint32)
    shell = language_id.Model([], letters, [], [], np.zeros(0))
    chars = np.array(list(map(ord, text)), np.uint32)
    keys = language_id.histories(shell.identifiers(chars), np.array([0, len(chars)]))
    grams = dict.fromkeys(["x"], np.unique(keys, return_counts=True))
    other = np.unique(keys[5:20], return_counts=True)
    model = language_id.estimate({**grams, "y": other}, letters)
    for history in np.unique(keys >> np.uint64(12))[:30].tolist() + [12345]:
        every = np.array([history << 12 | c for c in range(len(letters) + 2)], np.uint64) & np.uint64((1 << 60) - 1)
        assert np.exp(model.log_probabilities(every).astype(float)).sum(axis=0) == pytest.approx([1, 1], abs=1e-4)


def test_language_id_held_out(documents):
    model = language_id.fit(documents, usable=crc_fold(F.col("doc_id")) != 1)
    out = language_id.identify(documents, model).filter(crc_fold(F.col("doc_id")) == 1)
    hits = [r["lang"] == r["lang_pred"] for r in out.collect()]
    assert np.mean(hits) >= 0.98
    assert out.filter("rejected").count() <= 0.02 * len(hits)
    strange = documents.sparkSession.createDataFrame([("Ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 20,)], "text string")
    assert language_id.identify(strange, model).first()["rejected"]


def test_quality_held_out(spark):
    rng = np.random.default_rng(0)
    good = lambda: " ".join("".join(rng.choice(list("aeiourstln"), rng.integers(2, 9))) for _ in range(40)).capitalize() + ".\n"
    bad = lambda: " ".join(w.upper() + "!!" for w in good().split())
    rows = [(i, good() if i % 5 else bad(), int(i % 5 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, quality int")
    model = quality.fit(docs, labels, usable=crc_fold(F.col("doc_id")) != 1)
    held = quality.classify(docs, model).filter(crc_fold(F.col("doc_id")) == 1).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 > 0) for r in held]) > 0.95


def test_jpeg_round_trip_and_plain_scans():
    rng = np.random.default_rng(0)
    for n in (0, 1, 576, 577, 5000, 700_000):
        p = media.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert len(p) % 576 == 0 and jpeg.describe(jpeg.store(p))[0] == p


def encode_plain(coefs, ss, se, al_first):
    """A progressive grey image of sparse coefficients with runs, zero runs and refinement,
    written bit by bit: the counterpart of the decoder's general paths."""
    table = jpeg.flat_table(list(range(255)), 8)
    out = []
    put = lambda v, n: out.append(format(v, f"0{n}b") if n else "")

    def finish():
        bits = "".join(out)
        out.clear()
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")

    def magnitude(v):
        s = abs(v).bit_length()
        put(v if v > 0 else v + (1 << s) - 1, s)

    scans = []
    pred = 0
    for row in coefs:
        d = (int(row[0]) >> al_first) - pred
        pred += d
        put(abs(d).bit_length(), 8)
        if d:
            magnitude(d)
    scans.append((0, 0, 0, al_first, finish()))
    cut = lambda v: int(np.sign(v)) * (abs(int(v)) >> al_first)
    run = 0

    def flush():
        nonlocal run
        while run:
            r = min(run.bit_length() - 1, 14)
            put(r << 4, 8)
            n = min(run, (1 << r + 1) - 1)
            put(n - (1 << r), r)
            run -= n

    for row in coefs:
        zeros, todo = 0, [cut(v) for v in row[ss : se + 1]]
        last = max((i for i, v in enumerate(todo) if v), default=-1)
        for v in todo[: last + 1]:
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                put(15 << 4, 8)
                zeros -= 16
            put(zeros << 4 | abs(v).bit_length(), 8)
            magnitude(v)
            zeros = 0
        if last + 1 < len(todo):
            run += 1
    flush()
    scans.append((ss, se, 0, al_first, finish()))
    for k in range(al_first - 1, -1, -1):
        for row in coefs:
            put(int(row[0]) >> k & 1, 1)
        scans.append((0, 0, k + 1, k, finish()))
        for row in coefs:
            old = [abs(int(v)) >> k + 1 for v in row[ss : se + 1]]
            now = [abs(int(v)) >> k for v in row[ss : se + 1]]
            fresh = [i for i in range(len(now)) if now[i] and not old[i]]
            i, pending, zeros = 0, [], 0
            for j in range((fresh[-1] if fresh else -1) + 1):
                if old[j]:
                    pending.append(now[j] & 1)
                elif now[j]:
                    put(zeros << 4 | 1, 8)
                    put(int(row[ss + j] > 0), 1)
                    for b in pending:
                        put(b, 1)
                    pending, zeros = [], 0
                else:
                    zeros += 1
                    if zeros == 16:
                        put(15 << 4, 8)
                        for b in pending:
                            put(b, 1)
                        pending, zeros = [], 0
                i = j + 1
            if i < len(now) or pending or zeros:
                put(0, 8)
                for b in pending:
                    put(b, 1)
                for j in range(i, len(now)):
                    if old[j]:
                        put(now[j] & 1, 1)
        scans.append((ss, se, k + 1, k, finish()))
    return table, scans


def test_jpeg_general_scans():
    rng = np.random.default_rng(9)
    coefs = np.where(rng.random((12, 64)) < 0.15, rng.integers(-60, 61, (12, 64)), 0)
    coefs[:, 0] = rng.integers(-500, 500, 12)
    coefs[5:9, 1:] = 0
    coefs[2, 1:] = 0
    coefs[2, 60] = 7
    table, scans = encode_plain(coefs, 1, 63, 2)
    seg = jpeg.segment
    data = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC4, b"\x00" + table + b"\x10" + table)
    data += seg(0xC2, b"\x08" + (24).to_bytes(2, "big") + (32).to_bytes(2, "big") + b"\x01" + bytes([1, 0x11, 0]))
    for ss, se, ah, al, raw in scans:
        data += seg(0xDA, bytes([1, 1, 0x00, ss, se, ah << 4 | al])) + raw
    frame = jpeg.read_frame(data + b"\xff\xd9")
    assert (frame.components[0].coefs == coefs).all()
    rgb = jpeg.to_rgb(frame)
    assert rgb.shape == (24, 32, 3) and (rgb[..., 0] == rgb[..., 2]).all()


def test_inverse_transform_is_orthonormal():
    assert np.allclose(jpeg.BASIS @ jpeg.BASIS.T, np.eye(64))
    assert jpeg.ZIGZAG[:8].tolist() == [0, 1, 8, 16, 9, 2, 3, 10]


def test_archives_are_gzip_members_and_splittable(spark, tmp_path):
    rng = np.random.default_rng(0)
    noise = [rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes() for _ in range(12)]
    inner = b"".join(warc.member(warc.record(900 + i, "x", b"y" * 50, "0", None, False)) for i in range(3))
    rows = [(i, "u", noise[i] + warc.MAGIC * 3 + noise[-1 - i][:999]) for i in range(6)] + [(6, "u", b"tiny"), (7, "u", inner + noise[0])]
    pages = spark.createDataFrame([(i, u, bytearray(p)) for i, u, p in rows], "page_id long, url string, html binary")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    for f in (tmp_path / "w").glob("part-*"):
        if f.stat().st_size:
            assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", "20000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = {r["page_id"]: (bytes(r["payload"]), r["payload_digest"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
            assert got == {i: (p, hashlib.sha256(p).hexdigest()) for i, _, p in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_media_contract(documents, texts):
    for r in media.media_features(media.to_images(documents.limit(40))).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    tensors = media.rgb_tensors(media.to_images(documents.limit(2)).select("doc_id", F.explode("images").alias("image"))).collect()
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in tensors)


def test_pipeline(spark, documents):
    import corpus_pipeline as pipeline
    from conftest import DATA

    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "decontamination", "source_mixing"]
    docs = documents
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(DATA))
        if name != "source_mixing":
            assert tuple(out.columns) == pipeline.COLUMNS
            kept = {r["doc_id"]: r["text"] for r in out.collect()}
            given = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(kept) <= set(given)
        if name == "language_id":
            assert len(kept) >= 0.98 * len(given)
        if name == "simhash_near_dedup":
            fp = {i: plain_fingerprint(t) for i, t in given.items()}
            ids = list(fp)
            label = components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
            assert set(kept) == {i for i in ids if label[i] == i}
        if name == "substring_dedup":
            seen, want = set(), {}
            for i in sorted(given):
                w, gone = WORD.findall(given[i]), set()
                for s in range(len(w) - 19):
                    key = tuple(w[s : s + 20])
                    gone.update(range(s, s + 20) if key in seen else ())
                    seen.add(key)
                text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else given[i]
                if text or not gone:
                    want[i] = text
            assert kept == want
        if name == "decontamination":
            plain = lambda t: " " + re.sub(r"[^\w]+", " ", t.lower()).strip() + " "
            items = [plain(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            leaks = {i for i, t in given.items() if any(x in plain(t) for x in items)}
            assert not leaks & set(kept) and len(set(given) - set(kept) - leaks) <= 0.01 * len(given)
        if name == "source_mixing":
            assert out.count() == docs.count()
        docs = out
