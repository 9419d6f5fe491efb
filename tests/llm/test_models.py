"""Jaccard join, mixing, pieces, toxicity and LM scoring against brute force and the library."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import ORACLE_SF, SF
from fieldrollup.llm import jaccard_join, lm, mixing, pieces, queries, toxicity
from fieldrollup.llm import tokens as T

SCHEMA = "doc_id long, text string, block string"
ODD = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "y"), (None, "A b c", None), (5, "a B c", "z"), (5, "a B c", "z"), (6, "one two", "z"), (7, "x" * 70000 + " y", "z"), (8, "é ñ ▁ q", "z")]


def split(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def test_word_hashes():
    rng = random.Random(3)
    texts = [t for _, t, _ in ODD] + ["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 50))) for _ in range(200)]
    raw, offsets = T.text_bytes(pa.array(texts, pa.string()))
    want = [split(t) for t in texts]
    parts = [T.word_hashes(raw, offsets[a : b + 1]) for a, b in T.slices(offsets, 300)]
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    assert n.tolist() == [len(w) for w in want]
    names = {}
    for w, x in zip([w for ws in want for w in ws], h.tolist(), strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_blocks():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    arrays = [keys, np.arange(5, dtype=np.int32), np.zeros(0, np.uint64), keys[:1], np.array([1, 0], np.uint8)]
    for a, b in zip(arrays, T.decompress(T.compress(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
    edge = T.buckets_of(keys, 7)
    assert edge[0] == 0 and edge[-1] == 1000 and len(edge) == 8


def brute_jaccard(rows, k, percent):
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    for i, a in enumerate(sets):
        for j in {j for g in a for j in by[g] if j > i}:
            both = len(a & sets[j])
            if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows))


def near_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, t, b) for i, t, b in ODD]
    for g in range(12):
        base = [word() for _ in range(rng.choice([5, 30, 120]))]
        for c in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(c % 4):
                own[rng.randrange(len(own))] = word()
            rows.append((1000 + 50 * g + c, " ".join(own) + (" " + passage if g % 3 == 0 else ""), "b"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CHUNK_HASHES", 500)
    rows = near_rows()
    for k, percent in ((4, 85), (5, 80)):
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), words=k, percent=percent)
        assert Counter(map(tuple, got.collect())) == brute_jaccard([(i, t) for i, t, _ in rows], k, percent)
    if block == 3:
        assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_jaccard_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{ORACLE_SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op1_ngram_jaccard_join(spark, ORACLE_SF).collect())) == brute_jaccard(rows, 4, 85)


def test_search_probes():
    """Long lists are probed: the same links as by brute force."""
    rng = np.random.default_rng(2)
    common = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 62, rng.integers(2, 40), dtype=np.uint64)])) for _ in range(300)]
    sets += [np.unique(np.append(s[rng.random(len(s)) > 0.03], np.uint64(i))) for i, s in enumerate(sets[:60])]
    want = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                want.add((i, j))
    assert {(q, int(x)) for q, found in jaccard_join.search(sets, None) for x in found} == want
    left, right = sets[:150], sets[150:]
    assert {(q, int(x) + 150) for q, found in jaccard_join.search(right, left) for x in found} == {(a, b) for a, b in want if a < 150 <= b}


def fill(capacity, weights, budget):
    """Tokens of each leaf, by path: shortages are levelled among siblings, round by round, before what is left goes up."""
    children, room = defaultdict(list), defaultdict(float)
    for path, tokens in sorted(capacity.items(), key=repr):
        for k in range(len(path) + 1):
            if k and path[:k] not in children[path[: k - 1]]:
                children[path[: k - 1]].append(path[:k])
            room[path[:k]] += tokens
    out = {}

    def give(node, tokens):
        if node not in children:
            out[node] = tokens
            return
        share = dict.fromkeys(children[node], 0.0)
        open_, left = {c for c in share if room[c] > 0 and weights.get(c, 1.0) > 0}, min(tokens, room[node])
        while open_ and left > 1e-6:
            total = sum(weights.get(c, 1.0) for c in open_)
            full = {c for c in open_ if share[c] + left * weights.get(c, 1.0) / total >= room[c]}
            if not full:
                for c in open_:
                    share[c] += left * weights.get(c, 1.0) / total
                break
            for c in full:
                left -= room[c] - share[c]
                share[c] = room[c]
            open_ -= full
        for c in share:
            give(c, share[c])

    if capacity:
        give((), float(budget))
    return out


def budgets_of(spark, capacity, weights, budget, epochs=1):
    depth = len(next(iter(capacity)))
    names = [f"l{i}" for i in range(depth)]
    leaves = spark.createDataFrame([(*p, t, 1) for p, t in capacity.items()], ", ".join(f"{n} string" for n in names) + ", t long, n long")
    return {tuple(r[n] for n in names): r["given"] for r in mixing.budgets(leaves, names, weights, budget, epochs).collect()}


def test_budgets(spark):
    capacity = {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 10, ("b", "y"): 20, ("c", "z"): 0}
    out = budgets_of(spark, capacity, {("a",): 0.5, ("b",): 0.5, ("a", "x"): 3, ("a", "y"): 1}, 400)
    # b gives all it has, and a takes the rest; x can't fill 3/4 of it, so that y does
    assert out[("b", "x")] == 10 and out[("b", "y")] == 20
    assert out[("a", "x")] == 100 and abs(out[("a", "y")] - 270) < 1e-6 and out[("c", "z")] == 0
    rng = random.Random(2)
    for _ in range(6):
        capacity = {(a, b, c): rng.choice([0, 1, 10, 500, rng.randint(0, 3000)]) for a in ("a", None, "c") for b in "xyz" for c in "pqrs" if rng.random() < 0.7}
        weights = {p[:k]: rng.choice([0, 0.1, 1, 5, rng.random()]) for p in capacity for k in (1, 2, 3) if rng.random() < 0.6}
        total, epochs = sum(capacity.values()), rng.choice([1, 4])
        for budget in (0, total * rng.random(), total * epochs * rng.random(), total * epochs * 2):
            got, want = budgets_of(spark, capacity, weights, budget, epochs), fill({p: t * epochs for p, t in capacity.items()}, weights, budget)
            assert got.keys() == want.keys()
            for p, t in want.items():
                assert got[p] == pytest.approx(t, abs=1e-4), (p, capacity, weights, budget)


def brute_mix(spark, rows, kinds, weights, epochs, seed):
    """The rows that each leaf takes: whole passes, and of one more the prefix in the order of its seeded hashes."""
    hashed = spark.createDataFrame([(i, t or "") for i, t, _ in rows], "i long, t string")
    order = [tuple(r) for r in hashed.selectExpr("xxhash64(i, t) as own").selectExpr("own", *[f"xxhash64(own, {k}, {seed}) as p{k}" for k in range(epochs + 1)]).collect()]
    tokens = [len((t or "").split()) for _, t, _ in rows]
    n = Counter()
    for k, t in zip(kinds, tokens, strict=True):
        n[(k,)] += t
    given, out = fill({p: t * epochs for p, t in n.items()}, weights, sum(n.values())), Counter()
    for path, t in given.items():
        mine = [i for i, k in enumerate(kinds) if (k,) == path]
        full = min(epochs, math.floor(t / n[path] + 1e-9)) if n[path] else 0
        rest, before, edge = t - full * n[path], 0, None
        turn = lambda i: order[i][1 + full] % (1 << 64)  # noqa: B023, E731
        if rest >= 0.5:
            for i in sorted(mine, key=lambda i: (turn(i), order[i][0], tokens[i])):
                if before < rest:
                    edge = turn(i)
                before += tokens[i]
        for i in mine:
            for e in range(full + (edge is not None and turn(i) <= edge)):
                out[rows[i][0], kinds[i], tokens[i], e + 1] += 1
    return out


def test_mix(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", None, "\0null"])) for i in range(400)] + [(7, None, "a"), (8, "q " * 5000, "b")]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, epoch string")
    levels, weights = [("kind", F.col("epoch"))], {("a",): 3.0, ("b",): 0.5}
    want = brute_mix(spark, rows, [k for _, _, k in rows], weights, 2, 17)
    for size, leaves in ((100_000, 200_000), (20, 0)):
        monkeypatch.setattr(mixing, "RUN_ROWS", size)
        monkeypatch.setattr(mixing, "MAX_LEAVES", leaves)
        got = mixing.mix(df, levels, weights, max_epochs=2)
        assert Counter((r["row"]["doc_id"], r["kind"], r["n_tokens"], r["epoch"]) for r in got.collect()) == want
    assert mixing.mix(df.limit(0), levels, weights).count() == 0


def test_mix_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in queries.domain_levels()]
    rows = docs.select("doc_id", "text", *[e.alias(n) for n, e in queries.domain_levels()]).collect()
    words = {r["doc_id"]: len(split(r["text"])) for r in rows}
    room = Counter()
    for r in rows:
        room[tuple(r[n] for n in names)] += 4 * words[r["doc_id"]]
    want, taken = fill(room, queries.WEIGHTS, sum(words.values())), Counter()
    longest = Counter()
    for r in rows:
        path = tuple(r[n] for n in names)
        longest[path] = max(longest[path], words[r["doc_id"]])
    for r in queries.op2_mixing(spark, SF).collect():
        assert r["n_tokens"] == words[r["doc_id"]]
        taken[tuple(r[n] for n in names)] += r["n_tokens"]
    for p, t in want.items():
        assert t - 1 <= taken[p] <= min(room[p], t + longest[p]), p


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL_PATH, "rb") as f:
        return pieces.PieceModel(f.read())


def test_pieces_like_library(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rng = random.Random(1)
    texts = ["", " ", "Hello  world", "   ", "a▁b", "\n", "日本語 x  ", "he" * 60, "a" * 50, "        x"]
    texts += ["".join(rng.choice("aehinorst ▁é\n.TW") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids
        assert model.decode(ids) == library.decode(ids) == t.replace("▁", " ")


def test_unigram_viterbi():
    rng = random.Random(7)
    names = ["<unk>", "a", "b", "ab", "ba", "aab", "▁", "▁a", "bb", "▁ab"]
    listed = [(p, -rng.random() * 5, 2 if p == "<unk>" else 1) for p in names]
    own = pieces.PieceModel.of(listed, "unigram")
    score = {p: s for p, s, t in listed if t == 1}

    def brute(word):
        if not word:
            return 0.0, ()
        best = max(((score[word[:k]] + brute(word[k:])[0], (word[:k], *brute(word[k:])[1])) for k in range(1, len(word) + 1) if word[:k] in score), default=(-1e9, ()))
        if word[0] not in score:
            best = max(best, (own.floor + brute(word[1:])[0], ("<unk>", *brute(word[1:])[1])))
        return best

    words = sorted({"▁" + "".join(rng.choice("abx") for _ in range(rng.randint(0, 9))) for _ in range(120)})
    for word, ids in zip(words, own.encode_sorted(words), strict=True):
        # equal scores are open: "bbb" is b, bb or bb, b
        assert sum(own.floor if i == 0 else own.scores[i] for i in ids) == pytest.approx(brute(word)[0])
        assert "".join("x" if i == 0 else names[i] for i in ids) == word


def test_pieces_of_documents(spark):
    """Ids and counts of every document as the library gives them."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{ORACLE_SF}/documents.parquet").collect()}
    want = dict(zip(texts, library.encode(list(texts.values()), num_threads=1), strict=True))
    rows = {r["doc_id"]: r for r in queries.op3_sentencepiece(spark, ORACLE_SF).collect()}
    assert {i: r["piece_ids"] for i, r in rows.items()} == want
    assert all(r["exact"] and r["n_pieces"] == len(r["piece_ids"]) for r in rows.values())
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op5_token_counts(spark, ORACLE_SF).collect()} == {i: len(x) for i, x in want.items()}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(queries.op3_sentencepiece(spark, ORACLE_SF)).collect()}
    assert back == texts


def test_pieces_odd_rows(spark):
    odd = pieces.encode(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(odd) == len(ODD) and all(r["exact"] for r in odd) and [r["n_pieces"] for r in odd][:2] == [0, 0]
    assert pieces.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    named = pieces.encode(spark.createDataFrame([("x", "a b"), (None, None)], "doc_id string, text string")).collect()
    assert [r["doc_id"] for r in named] == ["x", None]


def test_long_words(model):
    """Neighbours that share nearly all of a million characters: linear in time."""
    import time

    import sentencepiece

    rng = random.Random(5)
    base = "".join(rng.choice("abcdehiknorst") for _ in range(1_000_000))
    began = time.process_time()
    words = sorted([f"\u2581{base}", f"\u2581{base}s", f"\u2581{base}st", f"\u2581{base[:-1]}q"])
    ids, counts = list(model.encode_sorted(words)), list(model.count_sorted(words))
    assert time.process_time() - began < 30
    assert [len(x) for x in ids] == counts
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    for cut in (1, 99, 5000):
        assert model.encode(base[:cut]) == library.encode(base[:cut])
    for word, x in zip(words, ids, strict=True):
        assert model.decode(x) == word[1:]


def test_pairs_of_pieces(model):
    rng, names = random.Random(3), list(model.ids)
    pairs = [(p[:i], p[i:]) for p in names[::5] for i in range(1, len(p))]
    pairs += [(rng.choice(names), rng.choice(names)) for _ in range(20_000)]
    pairs = [(x, y) for x, y in pairs if x in model.ids and y in model.ids]
    defined = [model.merge(x + y) == [x, y] for x, y in pairs]
    assert [model._compatible(model.ids[x] << 24 | model.ids[y]) for x, y in pairs] == defined and 0 < sum(defined) < len(pairs)


@pytest.mark.parametrize("counts_only", [False, True])
def test_full_books(model, counts_only, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 60)
    rng, book = random.Random(4), pieces.WordBook(model, counts_only)
    often = [pieces.MARK + "".join(rng.choices("abcde", k=4)) for _ in range(10)]
    for k in range(40):
        words = often[: rng.randrange(11)] + [pieces.MARK + "".join(rng.choices("abcde", k=5)) for _ in range(100 if k == 20 else 25)]
        place = book.places(words)
        ids = [next(model.encode_sorted([w])) for w in words]
        assert [book.lengths[i] for i in place] == [len(x) for x in ids] and len(book.again) == len(book.lengths) == len(book.place)
        if not counts_only:
            flat, edge = book.gather(place)
            assert [flat[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == ids and all(book.exact[i] for i in place)
        assert len(book.place) <= 60 + len(words)


def test_exact_per_word(model):
    book = pieces.WordBook(model, counts_only=False)
    book.lengths.append(0)
    assert book._decode_again(["\u2581a"], book.flat) == [False]
    book.clear()
    place = book.places(["\u2581a", "\u2581b", "\u2581a"])
    assert list(book.exact) == [1, 1] and place.tolist() == [0, 1, 0]


def brute_lm(rows):
    docs = []
    for i, t in rows:
        crc = zlib.crc32(("" if i is None else str(i)).encode())
        docs.append((i, [*split(t), "$end"], crc % 5 == 1))
    train = [w for _, ws, h in docs if not h for w in ws]
    c, n = Counter(train), len(train)
    return {
        (i, h, len(ws), sum(c[w] > 0 for w in ws), n): sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in ws) for i, ws, h in docs
    }


def brute_score(rows, spark):
    """Bigram scores by dictionaries: counts, EM over the deleted documents, and interpolation."""
    crcs = [zlib.crc32(("" if i is None else str(i)).encode()) for i, _ in rows]
    turns = [r[0] for r in spark.createDataFrame([(c,) for c in crcs], "c long").selectExpr(f"pmod(xxhash64(c), {lm.HELD_EVERY})").collect()]
    docs = [[*split(t), "$end"] for _, t in rows]
    train = [c % 5 != 1 for c in crcs]
    gone = [t and k == 0 for t, k in zip(train, turns, strict=True)]

    def counted(chosen):
        one, two = Counter(), Counter()
        for ws, ok in zip(docs, chosen, strict=True):
            if ok:
                one.update(ws)
                one["$start"] += 1
                two.update(zip(["$start", *ws[:-1]], ws, strict=True))
        return one, two, sum(n for w, n in one.items() if w != "$start")

    def parts(ws, counts, v):
        one, two, n = counts
        for before, w in zip(["$start", *ws[:-1]], ws, strict=True):
            yield one[before], (two[before, w] / one[before] if one[before] else 0.0), one[w] / max(n, 1), 1 / (v + 1)

    bucket = lambda c: min(c.bit_length(), lm.BUCKETS - 1)
    whole = counted(train)
    v = len(whole[0]) - 1
    kept = counted([t and not g for t, g in zip(train, gone, strict=True)])
    step = lambda p: 2 ** (round(lm.STEPS * math.log2(p * (v + 1))) / lm.STEPS) if p > 0 else 0.0
    seen = defaultdict(Counter)
    for ws, g in zip(docs, gone, strict=True):
        if g:
            for c, p2, p1, _ in parts(ws, kept, v):
                seen[bucket(c)][step(p2), step(p1)] += 1
    weights = {0: (0.0, 0.8, 0.2)}
    for b in range(lm.BUCKETS):
        w = (0.0, 0.8, 0.2) if b == 0 else (0.4, 0.4, 0.2)
        if not seen[b]:
            weights[b] = w if b < 2 else weights[b - 1]
            continue
        for _ in range(200):
            total = [1.0 if b else 0.0, 1.0, 1.0]
            for (p2, p1), n in seen[b].items():
                cell = (w[0] * p2 * (b > 0), w[1] * p1, w[2])
                for k in range(3):
                    total[k] += n * cell[k] / sum(cell)
            new = tuple(t / sum(total) for t in total)
            done = max(abs(x - y) for x, y in zip(new, w, strict=True)) < 1e-7
            w = new
            if done:
                break
        weights[b] = w
    return [sum(math.log10(sum(l * p for l, p in zip(weights[bucket(c)], (p2, p1, p0), strict=True))) for c, p2, p1, p0 in parts(ws, whole, v)) for ws in docs], weights


@pytest.mark.parametrize("small", [False, True])
def test_lm(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = rows[:60] if small else rows + [(i, t) for i, t, _ in ODD] + [(90_001, "lorem ipsum dolor " * 60_000)]
    options = {"chunk_words": 200, "range_words": 3000} if small else {}
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    want = brute_lm(rows)
    scores, _ = brute_score(rows, spark)
    of = defaultdict(list)
    for (i, _), x in zip(rows, scores, strict=True):
        of[i].append(x)
    assert len(got) == len(rows)
    for r in got:
        key = (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])
        assert abs(r["base_score"] - want[key]) < 1e-6 * abs(want[key]) + 1e-9
        assert min(abs(r["score"] - x) / abs(x) for x in of[r["doc_id"]]) < 1e-5
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_chunks_are_cut(spark):
    rows = [(i, f"w{i} " * 50, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").coalesce(1)
    chunks = df.mapInArrow(lm.make_chunks(200), lm.CHUNK_SCHEMA).collect()
    assert len(chunks) >= 5 and sum(r["n_words"] for r in chunks) == 40 * 51
    assert len({r["chunk"] for r in chunks}) == len(chunks) and {r["chunk"] % 2 for r in chunks} == {0, 1}


def test_lm_empty(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em():
    """Weights that a mixture was drawn with are found again."""
    rng, cells, true = np.random.default_rng(0), Counter(), (0.6, 0.3, 0.1)
    # events of three models; each has its own likely half
    p = np.array([[8.0, 1 / 8, 1.0], [1 / 8, 8.0, 1.0], [1.0, 1.0, 1.0], [1 / 8, 1 / 8, 1.0]])
    chance = [np.array([8.0, 0.125, 1.0, 0.125]), np.array([0.125, 8.0, 1.0, 0.125]), np.ones(4)]
    mix = sum(w * c / c.sum() for w, c in zip(true, chance, strict=True))
    ratio = np.column_stack([c / c.sum() for c in chance])
    ratio = ratio / ratio[:, 2:]
    for i in rng.choice(4, 200_000, p=mix / mix.sum()):
        cells[5, round(lm.STEPS * math.log2(ratio[i, 0])), round(lm.STEPS * math.log2(ratio[i, 1]))] += 1
    w = lm.learn_weights(np.array([(*k, n) for k, n in cells.items()]))
    assert abs(w.sum(axis=1) - 1).max() < 1e-9 and (w[1:] > 0).all() and w[0, 0] == 0
    assert np.abs(w[5] - true).max() < 0.05 and (w[6] == w[5]).all() and p.shape == (4, 3)


def brute_kneser_ney(toxic, ordinary):
    """Log ratios of words by dictionaries: six-grams of bytes in a word and the space after it."""

    def grams(word):
        b = word.encode().lower() + b" "
        return [(b"\0" * 6 + b)[k + 1 : k + 7] for k in range(len(b))]

    count = [Counter(g for w, n in c.items() for g in grams(w) for _ in range(n)) for c in (toxic, ordinary)]
    types = set(count[0]) | set(count[1])
    d = toxicity.DISCOUNT
    follow = {5: Counter(g[1:] for g in types)}
    for k in (4, 3, 2, 1):
        follow[k] = Counter(g[1:] for g in follow[k + 1])

    def lower(g):
        if not g:
            return 1 / 256
        own = follow[len(g)]
        same = [n for x, n in own.items() if x[:-1] == g[:-1]]
        return max(own[g] - d, 0) / sum(same) + d * len(same) / sum(same) * lower(g[1:])

    shared, of_context = {}, defaultdict(list)
    for g in types:
        of_context[g[:-1]].append(g)

    def log_p(c, g):
        own = [count[c][x] for x in of_context.get(g[:-1], []) if count[c][x]]
        back = d * len(own) / sum(own) if own else 1.0
        if g not in types:  # the shared probability cancels out
            return math.log(back)
        if g not in shared:
            shared[g] = lower(g[1:])
        return math.log(max(count[c][g] - d, 0) / max(sum(own), 1) + back * shared[g])

    return lambda word: sum(log_p(0, g) - log_p(1, g) for g in grams(word))


def test_kneser_ney():
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    toxic, ordinary = (Counter(word(x) for _ in range(120)) for x in ("abcdZ\u00e9", "cdefgh"))
    batch = pa.RecordBatch.from_pylist([{"word": w, "toxic": t, "n": n} for t, c in ((1, toxic), (0, ordinary)) for w, n in c.items()])
    found = next(iter(toxicity.count_grams(iter([batch]))))
    gram, both = found.column(0).to_numpy(), [found.column(i).to_numpy().astype(float) for i in (1, 2)]
    order = np.argsort(gram)
    model = toxicity.fit(gram[order].view(np.uint64), both[0][order], both[1][order])
    want = brute_kneser_ney(toxic, ordinary)
    words = [*toxic, *ordinary, *(word("abcdefghxyz") for _ in range(200)), "ab" * 700]
    raw, offsets = T.text_bytes(pa.array(words))
    for group in (1 << 19, 64, 7):
        got = model.word_ratios(raw, offsets[:-1], np.diff(offsets), group)
        assert np.allclose(got, [want(w) for w in words], rtol=1e-4, atol=1e-3)


def test_very_long_texts(spark):
    """Texts of some megabytes, and one word of that length, end to end."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300_000))
    near = long.replace("abcd", "abce", 3)
    rows = [(1, long, "x"), (2, near, "x"), (3, "q" * 2_000_000, "x"), (4, "q" * 2_000_001, "x"), (5, "a b c d e", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, jaccard_join.jaccard_components(df).collect())) == brute_jaccard([(i, t) for i, t, _ in rows], 4, 85)
    encoded = pieces.encode(df).collect()
    assert all(r["exact"] for r in encoded)
    assert [r["n_tokens"] for r in pieces.token_counts(df).collect()] == [r["n_pieces"] for r in encoded]
    labels = spark.createDataFrame([(5, 1), (1, 0)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(df, labels).collect())


def test_toxicity(spark):
    bad = ["loser", "scum"]
    rng = random.Random(9)
    text = lambda toxic: " ".join([rng.choice(["one", "two", "three", "lose", "some", "ten"]) for _ in range(40)] + ([rng.choice(bad)] if toxic else []))
    rows = [(i, text(i % 5 == 0), "s") for i in range(600)] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(rows)
    for r, (i, _, _) in zip(got, rows, strict=True):
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2)
        if i is not None and 10 < i < 600:
            assert r["predicted"] == int(i % 5 == 0)
    whole = toxicity.toxicity(df, labels, carry=True)
    assert whole.select("row.*").columns == df.columns
    assert {r["score"] for r in toxicity.toxicity(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def test_pipeline(spark):
    """Each stage against brute force, on what the stage before it kept; then the whole."""
    import corpus_pipeline
    import sentencepiece
    from pyspark.sql import functions as F

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    assert ids(clean) == sorted(r["doc_id"] for r in queries.op4_toxicity(spark, SF).where("predicted = 0").collect())
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    squeezed = defaultdict(list)
    for i, t in texts.items():
        squeezed[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    single = corpus_pipeline.drop_copies(spark, clean, SF)
    assert ids(single) == sorted(min(g)[1] for g in squeezed.values())
    apart = corpus_pipeline.drop_near_copies(spark, single, SF)
    assert ids(apart) == sorted(i for i, _, c, _ in brute_jaccard([(i, texts[i]) for i in ids(single)], 5, 80) if i == c)
    mixed = corpus_pipeline.mix_sources(spark, apart, SF)
    assert set(ids(mixed)) <= set(ids(apart)) and mixed.columns == docs.columns
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_pieces", "piece_ids", "exact"]
    assert ids(out) == ids(mixed)
    want = {r["doc_id"]: library.encode(r["text"] or "") for r in mixed.dropDuplicates(["doc_id"]).collect()}
    assert all(r["piece_ids"] == want[r["doc_id"]] for r in out.collect())
    assert out.where(~F.col("exact")).isEmpty()


def test_pipeline_odd_rows(spark):
    import corpus_pipeline

    rows = [(i, t, "en", "src1", 0, "s", True, 1) for i, t, _ in near_rows(3)] + [(None, None, None, None, None, "s", None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, kept boolean, row_id int"
    docs = spark.createDataFrame(rows, names)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert k == 4 or stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.encode_pieces(spark, docs, SF).count() == len(rows)
    squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    once = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert sorted(squeezed(r["text"]) for r in once) == sorted({squeezed(r[1]) for r in rows})
    apart = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    want = brute_jaccard([(i, r[1]) for i, r in enumerate(rows)], 5, 80)
    assert len(apart) == len({c for (_, n, c, _) in want if n}) + sum(k for (_, n, _, _), k in want.items() if not n)
    assert corpus_pipeline.mix_sources(spark, docs, SF).count() > 0


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in queries.op4_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in labels]
    bad, good = sorted(s for s, t in rows if t), sorted(s for s, t in rows if not t)
    assert len(bad) > 50
    area = sum(np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")) / 2 / len(bad) / len(good)
    assert area > 0.9
    assert np.mean(np.array(good) >= toxicity.THRESHOLD) < 0.05
