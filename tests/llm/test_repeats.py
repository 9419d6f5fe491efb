"""Merged transforms and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import ORACLE_SF
from fieldrollup.llm import bwt, queries, repeats
from fieldrollup.llm.tokens import text_bytes


def collection(strings):
    codes, after = [], []
    for s in strings:
        base = len(codes)
        codes += [*s, 0]
        after += [*range(base + 1, base + len(s) + 1), base + len(s)]
    return np.array(codes), np.array(after), max(map(len, strings))


def suffix(codes, row):
    out = []
    while codes[row]:
        out.append(int(codes[row]))
        row += 1
    return out


def test_merge_of_transforms():
    rng = random.Random(1)
    for _ in range(40):
        groups = [[[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        parts = [collection(g) for g in groups]
        shards = [bwt.transform(*p) for p in parts]
        for (codes, _, _), s in zip(parts, shards, strict=True):
            names = [suffix(codes, r) for r in s.rows]
            assert names == sorted(names)
        for rounds in (1, 3, 12):
            order, prefix = bwt.merge(shards, rounds)
            every = [(*suffix(p[0], r), 0)[:rounds] for p, s in zip(parts, shards, strict=True) for r in s.rows]
            got = [every[i] for i in order]
            assert sorted(order) == list(range(len(every)))
            full = [[*g, *[0] * 20] for g in got]
            # order by the first symbols; a sentinel ends what is compared
            assert got == sorted(got)
            for j in range(1, len(got)):
                n = 0
                while n < rounds and n < len(got[j]) and n < len(got[j - 1]) and got[j][n] == got[j - 1][n]:
                    n += 1
                    if got[j][n - 1] == 0:
                        n = max(n, int(prefix[j]))
                        break
                assert prefix[j] == n
            del full


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def fixture(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passage, copied = noise(70), noise(90)
    texts = [None, "", "short", copied, copied, copied, "a" * 60, noise(19), "xy" * 40, passage]
    for _ in range(25):
        t = noise(rng.randint(0, 80))
        if rng.random() < 0.5:
            a = rng.randint(0, 40)
            t += passage[a : a + rng.randint(5, 60)] + noise(rng.randint(0, 30))
        texts.append(t)
    near = noise(200)
    for _ in range(4):
        i = rng.randrange(len(near))
        texts.append(near[:i] + "Q" + near[i + 1 :])
    return texts


@pytest.mark.parametrize(("length", "gram", "step", "hot"), [(20, 4, 5, 500), (20, 6, 1, 500), (24, 8, 12, 500), (20, 4, 5, 2), (24, 8, 12, 0)])
def test_repeats(spark, length, gram, step, hot):
    texts = fixture(length + step)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "n" * 30, "x"), (3, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sha string").repartition(3)
    got = repeats.without_repeats(df, length=length, gram=gram, step=step, hot=hot).collect()
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], length), strict=True))
    assert Counter(map(tuple, got)) == want


def test_repeats_of_very_long_texts(spark):
    """Texts longer than what is looked at at once, with a passage on both sides of a cut."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    passage = noise(900)
    at = repeats.PIECE - 450
    texts = [noise(at) + passage + noise(200_000), noise(3 * repeats.PIECE) + passage, noise(5000) + passage[:401], "z" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, *b) for i, b in enumerate(brute(texts, 400)))
    assert Counter(map(tuple, repeats.without_repeats(df).collect())) == want


def test_repeats_empty(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ORACLE_SF}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 400), strict=True))
    assert Counter(map(tuple, queries.op10_suffix_dedup(spark, ORACLE_SF).collect())) == want


def test_pieces_cover_every_window(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    raw, offsets = text_bytes(pa.array(["x" * 300, "", "abc" * 10, "y" * 64, "z" * 63]))
    seen = Counter()
    for at, bounds, before in repeats.pieces(offsets, 20):
        for k in range(len(bounds) - 1):
            for p in range(int(bounds[k]), int(bounds[k + 1]) - 19):
                seen[at + k, p - int(offsets[at + k])] += 1
            before = 0
    assert seen == Counter({(i, p): 1 for i in range(5) for p in range(int(offsets[i + 1] - offsets[i]) - 19)})
