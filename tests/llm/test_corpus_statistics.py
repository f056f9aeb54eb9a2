"""Collocations, importance resampling and line dedup against brute force, on random and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobtide.llm import collocations, line_dedup, resampling, spans

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "a bb Ccc dd éé of the İx naïve".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", " x", "　", ";", "\x1c"]
    made = [(i, "".join(rng.choice(WORDS) + rng.choice(gaps) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, ""])) for i in range(90)]
    long_ = " ".join(rng.choice(WORDS) for _ in range(4000))
    made += [(5, made[5][1], "en"), (5, made[5][1], "en"), (None, long_, "en"), (None, None, None), (200, "", "fr"), (201, "w" * 9000 + " of the", "fr"),
             (202, None, "en"), (203, " \t\n ", None), (204, long_.upper(), None)]
    return made


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    """A table of several files with columns that clash with names inside the operators."""
    path = f"{tmp_path_factory.mktemp('texts')}/documents"
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    clash = {c: F.lit("clash") for c in ("row", "rank", "score", "part", "phrase", "places", "kept", "lines", "f", "h1", "docs", "batch", "r", "n_words")}
    df.repartition(3).withColumns(clash).write.parquet(path)
    return spark.read.parquet(path)


# spans

@pytest.mark.parametrize("size", [1 << 21, 40])
def test_parts_of_a_long_text_hold_each_gram_once(texts, size):
    for longest in (2, 3):
        seen = Counter()
        raw = [(t or "").encode() for _, t, _ in texts[:100]]
        for cut in spans.cuts(raw, collocations.KINDS, longest, size):
            data = cut.text.tobytes()
            for n in range(1, longest + 1):
                for at in cut.grams(n).tolist():
                    seen[int(cut.docs[at]), int(cut.number[at]), data[cut.starts[at] : cut.ends[at + n - 1]]] += 1
        want = Counter()
        for d, text in enumerate(raw):
            number = 0
            for piece in re.split(rb"[.,;:!?\x0A-\x0D]", text.lower()):
                w = [x for x in re.split(rb"[ \t]+", piece) if x]
                for n in range(1, longest + 1):
                    for i in range(len(w) - n + 1):
                        want[d, number + i, b" ".join(w[i : i + n])] += 1
                number += len(w)
        assert seen == want


def test_same_bytes_at_every_length():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(0, 2, 400, dtype=np.uint8), np.zeros(8, np.uint8)])
    a, b = rng.integers(0, 300, 3000), rng.integers(0, 300, 3000)
    size = rng.integers(0, 40, 3000)
    b[::3] = a[::3]
    got = spans.same_bytes(text, a, b, size)
    assert got.tolist() == [text[x : x + z].tobytes() == text[y : y + z].tobytes() for x, y, z in zip(a, b, size)]


# 11 collocations

def slow_collocations(rows, least, longest, share, first):
    f, n, out = Counter(), Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in found.items():
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if not any(other == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                   for (other, q), b in found.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:first], 1))


@pytest.mark.parametrize("longest,batch,bucket", [(3, 2_000_000, 8 << 20), (4, 300, 2000)])
def test_collocations_match_brute_force(docs, texts, monkeypatch, longest, batch, bucket):
    monkeypatch.setattr(collocations, "BATCH", batch)
    got = collocations.collocations(docs, least=4, longest=longest, first=25, bucket_bytes=bucket, filter_bits=1 << 12).collect()
    assert sorted(map(tuple, got)) == slow_collocations([(lang, t) for _, t, lang in texts], 4, longest, 50, 25)


def test_equal_fingerprints_of_different_phrases_fall_apart(docs, texts, monkeypatch):
    weak = lambda self, cut, prefixes, at, n, langs: np.full(len(at), n, np.uint64) + (cut.starts[at] * 0 + cut.ends[at + n - 1] - cut.starts[at]).astype(np.uint64)
    monkeypatch.setattr(collocations.Hasher, "grams", weak)  # the length is all that a fingerprint knows
    got = collocations.collocations(docs, least=4, longest=3, first=25).collect()
    assert sorted(map(tuple, got)) == slow_collocations([(lang, t) for _, t, lang in texts], 4, 3, 50, 25)


@pytest.fixture
def many_batches(monkeypatch):
    monkeypatch.setattr(collocations, "BATCH", 100)
    monkeypatch.setattr(collocations, "cuts", lambda raw, kinds, longest: spans.cuts(raw, kinds, longest, 400))


def test_each_frequent_phrase_is_read_once_over_many_batches(docs, texts, many_batches):
    rows = collocations.rows_of(docs, "lang", "text")
    packed = collocations.gram_entries(rows, 2, 2, np.full(1 << 10, 255, np.uint8), 1).cache()  # the filter lets all through
    assert packed.count() > 10
    entries = collocations.frequent_entries(packed, 2, 4)
    want = Counter()
    for _, text, lang in texts:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            want.update(("und" if lang is None else lang, " ".join(w[i : i + 2]), 2) for i in range(len(w) - 1))
    want = sorted((*k, f) for k, f in want.items() if f >= 4)
    assert entries.count() == len(want)
    assert sorted(map(tuple, collocations.read_phrases(rows, entries.drop("fp"), 2).collect())) == want


def test_equal_fingerprints_fall_apart_over_many_batches(docs, texts, many_batches, monkeypatch):
    class Weak(collocations.Hasher):  # a class of the test travels to the tasks
        def grams(self, cut, prefixes, at, n, langs):
            return np.full(len(at), n, np.uint64)

    monkeypatch.setattr(collocations, "Hasher", Weak)
    got = collocations.collocations(docs, least=4, longest=3, first=25).collect()
    assert sorted(map(tuple, got)) == slow_collocations([(lang, t) for _, t, lang in texts], 4, 3, 50, 25)


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text is null")).count() == 0


# 12 resampling

def slow_resampling(rows, target, share, least, longest, buckets, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    made = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    big, small = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for d, n, f in made:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    for i, r in enumerate(able):
        r.append(i + 1 if i < len(able) * share // 100 else None)
    return Counter(tuple([r[0], *r[2:5], r[5] if len(r) > 5 else None]) for r in out)


@pytest.mark.parametrize("share,buckets", [(5, 10_000), (60, 7)])
def test_resampling_matches_brute_force(spark, docs, texts, share, buckets):
    target = ["of the naïve İx", "the the dd bb a", None, "", "of the of the of the"]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, goal, share=share, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == slow_resampling([(d, t) for d, t, _ in texts], target, share, 20, 3, buckets, 42)
    assert resampling.resample(docs.limit(0), goal).count() == 0
    assert resampling.resample(docs, goal.limit(0)).count() == len(texts)


def test_table_tells_equal_keys_apart(monkeypatch):
    words = [random.Random(4).choice(WORDS) for _ in range(300)]
    cut = next(spans.cuts([" ".join(words).encode()], resampling.KINDS, 3))
    plain = resampling.Features(cut, 3, 1 << 31)
    monkeypatch.setattr(resampling, "xxh64", lambda text, starts, sizes: np.full(len(starts), 3, np.uint64))
    weak = resampling.Features(cut, 3, 1 << 31)
    assert (plain.bucket[plain.slots] == weak.bucket[weak.slots]).all() and (plain.count[plain.slots] == weak.count[weak.slots]).all()
    assert len(weak.taken) == len(plain.taken) == len(set(plain.bucket[plain.slots].tolist()))


def test_checksums_and_hashes_are_the_libraries():
    rng = random.Random(6)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 23, 24, 31, 32, 33, 64, 127, 128, 300]))) for _ in range(400)]
    text = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    size = np.array([len(x) for x in parts])
    start = np.cumsum(size) - size
    assert spans.xxh64(text, start, size).tolist() == [xxhash.xxh64_intdigest(x) for x in parts]
    crc = np.array([zlib.crc32(x) for x in parts], np.uint32)
    assert spans.crc_joined(crc, crc[::-1], size[::-1]).tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[::-1])]


# 13 line dedup

def slow_lines(rows, threshold, least=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or seen[key(x)] < threshold]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.fixture(scope="module")
def lined(spark, tmp_path_factory):
    rng = random.Random(37)
    pool = [f"Line {i} with é" for i in range(60)] + ["", " ", " ", "Hot line", "x"]
    rows = [(i, "\n".join(rng.choice([" ", "", "\t"]) + rng.choice([x, x.upper(), x.lower()]) + rng.choice([" ", "", "\r"])
                          for x in rng.choices(pool, k=rng.randrange(12)) + rng.choices(["Hot line", "own %d" % i], k=1))) for i in range(150)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, None), (None, "Hot line"), (900, ""), (901, "\n\n"), (902, "Same\n" * 30), (903, "hot LINE\n" * 5000 + "end")]
    path = f"{tmp_path_factory.mktemp('lined')}/documents"
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("row", "mark", "lines", "places", "kept", "seen", "r", "h1", "key")})
    df.repartition(3).write.parquet(path)
    return rows, spark.read.parquet(path)


@pytest.mark.parametrize("threshold,batches,fanout,heavy", [(10, 4, 3, 10_000), (4, 7, 2, 3), (2, 1, 2, 1), (400, 3, 2, 10)])
def test_dropped_lines_match_brute_force(lined, threshold, batches, fanout, heavy):
    rows, df = lined
    got = line_dedup.dropped_lines(df, threshold=threshold, batches=batches, fanout=fanout, heavy=heavy).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter({(d, n, m, sha(t)): c for (d, n, m, t), c in slow_lines(rows, threshold).items()})


def test_without_lines_keeps_rows_and_columns(lined):
    rows, df = lined
    out = line_dedup.without_lines(df, threshold=10, least_chars=2)
    assert out.columns == df.columns and {r.kept for r in out.collect()} == {"clash"}
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(
        {k: sum(c for (d, _, _, t), c in slow_lines(rows, 10, 2).items() if (d, t) == k) for k in {(d, t) for d, _, _, t in slow_lines(rows, 10, 2)}})
    assert line_dedup.without_lines(df.limit(0)).count() == 0


def test_runs_settle_what_batches_hold_together(spark):
    rng = random.Random(41)
    runs, total = line_dedup.Runs(5, fanout=2), Counter()
    for _ in range(6):
        batch = Counter({h: rng.randrange(1, 4) for h in rng.sample(range(30), 12)})
        runs.add(spark.createDataFrame([(h, -h, n) for h, n in batch.items()], "h1 long, h2 long, docs long"))
        total += batch
        assert all(len(level) < 2 for level in runs.levels)
    assert sorted(r.h1 for r in runs.frequent().collect()) == sorted(h for h, n in total.items() if n >= 5)
