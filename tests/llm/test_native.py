"""Exact dedup, sharding and quality rules: oracles, brute force and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import ORACLE_SF, assert_matches_oracle
from fieldrollup.llm import queries as q
from fieldrollup.llm.exact_dedup import exact_duplicates
from fieldrollup.llm.quality import quality
from fieldrollup.llm.sharding import greedy_cuts, shards, smallest_capacity

ODD = [
    (1, "a b c", "x"), (2, "abc", "y"), (3, None, "z"), (4, "", None), (5, " \t\n", "z"), (None, "a bc", "n"), (6, "abc d", "w"),
    (7, "é" * 90 + " tail", "l"), (8, "é" * 90 + "tail", "l"), (9, "é" * 90 + "tale", "l"), (10, "z" * 70000, "l"), (11, "z" * 70000, "l"),
    (12, "z" * 69999 + "y", "l"), (2, "abc", "y"), (13, "q " * 60000, "l"), (14, "q" * 60000, "l"),
]
SCHEMA = "doc_id long, text string, gid string"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_oracle(spark, name):
    assert_matches_oracle(spark, name, q.queries()[name], q.oracle_sql()[name])


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("rows", [ODD, [], [(5, "x", "a")] * 3, [(i, "same text " * 20, "s") for i in range(50)]])
def test_exact_dedup(spark, rows):
    got = [r.asDict() for r in exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[squeezed(t)].append((i, len(t or "")))
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(groups)
    want = Counter()
    for t, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0]))[0]
        for i, _ in members:
            want[(i, keep, len(members), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def brute_capacity(sizes, n):
    best = {0: {0: 0}}
    totals = [0]
    for s in sizes:
        totals.append(totals[-1] + s)
    f = [[float("inf")] * (len(sizes) + 1) for _ in range(n + 1)]
    f[0][0] = 0
    for k in range(1, n + 1):
        for j in range(len(sizes) + 1):
            f[k][j] = min((max(f[k - 1][i], totals[j] - totals[i]) for i in range(j + 1)), default=float("inf"))
    del best
    return f[n][len(sizes)]


def test_smallest_capacity():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.choice([1, 3, 9, 50]) for _ in range(rng.randint(1, 25))]
        n = rng.randint(1, 6)
        c = smallest_capacity(sizes, n)
        assert c == brute_capacity(sizes, n)
        ends = greedy_cuts(sizes, c)
        assert len(ends) <= n and ends[-1] == len(sizes)


def check_shards(rows, got, n):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t, *_ in rows:
        groups[(int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16))] += len((t or "").encode()) + 8
    sizes = [s for _, s in sorted(groups.items())]
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    if rows:
        assert max(loads.values()) == smallest_capacity(sizes, n)


@pytest.mark.parametrize("rows", [ODD, [], [(5, "x", "a")] * 3, [(i, f"t{i % 7}" * (i % 90), "s") for i in range(400)]])
def test_shards(spark, rows, monkeypatch):
    from fieldrollup.llm import sharding

    got = [r.asDict() for r in shards(spark.createDataFrame(rows, SCHEMA), 5).collect()]
    check_shards(rows, got, 5)
    for name, value in (("BITS", 2), ("MORE_BITS", 2), ("MAX_GROUPS", 3), ("CELL_ROWS", 2)):
        monkeypatch.setattr(sharding, name, value)
    assert Counter(r["size"] for r in shards(spark.createDataFrame(rows, SCHEMA), 5).collect()) == Counter(r["size"] for r in got)
    check_shards(rows, [r.asDict() for r in shards(spark.createDataFrame(rows, SCHEMA), 5).collect()], 5)


def test_shards_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ORACLE_SF}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(rows, [r.asDict() for r in q.op7_sharding(spark, ORACLE_SF).collect()], 24)


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def test_quality(spark):
    rng = random.Random(2)
    rows = [*ODD, *[(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + "\n" * (i % 3) + "a  b\na  b\n \n", "r") for i in range(40)]]
    got = quality(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [brute_quality(t) for _, t, _ in rows]
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plans_are_native(spark):
    for name in ("op7_sharding", "op8_quality_rules"):
        plan = q.queries()[name](spark, ORACLE_SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
