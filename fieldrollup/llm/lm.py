"""Language-model scoring by deleted interpolation.

p(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1), the weights (l2, l1, l0) by
the frequency bucket of the context v, learned by expectation-maximisation: one training
document in HELD_EVERY is deleted from the counts and serves as the held-out text.

All documents are read and all counts are exact and distributed. Texts are turned into
chunks of word ids. Each chunk asks for the counts of its distinct words and word pairs, in
one block for each range of the 64-bit key space; the task of a range adds up what all
chunks bring and answers each of them with the sums. So a word or pair costs one entry for
each chunk that has it, however frequent it is, and no counts go to the driver or to all
executors. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldrollup.llm.common import Staging
from fieldrollup.llm.tokens import SLICE_BYTES, U, buckets_of, compress, decompress, lean, mix, slices, text_bytes, word_hashes

#: Words of a chunk, and words that one key range should hold.
CHUNK_WORDS, RANGE_WORDS = 1_000_000, 1_500_000
#: Of training documents, those whose crc32 leaves 0 by this are the held-out text of the weights.
HELD_EVERY = 20
#: Context buckets: bit lengths of the context's count, up to this.
BUCKETS = 24
#: Steps of an octave in which the logarithms of probability ratios are tallied for EM.
STEPS = 8
END, START = U(0xE5D1C3B7A9F80642), U(0x1B873593CC9E2D51)
PAIR = U(0xD6E8FEB86659FD93)

CHUNK_SCHEMA = "chunk long, bucket int, block binary, n_words long, n_train long"


def pair_keys(previous: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(previous * PAIR + (word ^ (word >> U(29))))


def _contexts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The word before each; START at the first of a document. counts: words of each, END included."""
    previous = np.empty_like(hashes)
    previous[1:] = hashes[:-1]
    previous[np.cumsum(counts) - counts] = START
    return previous


def _chunk(key: int, hashes: list[np.ndarray], counts: list[np.ndarray], ids: list, train: list[np.ndarray]) -> dict:
    h, n, t = np.concatenate(hashes), np.concatenate(counts), np.concatenate(train)
    distinct, back, freq = np.unique(h, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.int32)  # frequent words get small ids, which compress
    rank[np.argsort(-freq, kind="stable")] = np.arange(len(distinct), dtype=np.int32)
    by_rank = np.empty_like(distinct)
    by_rank[rank] = distinct
    valid = np.array([i is not None for i in ids])
    doc = np.array([0 if i is None else i for i in ids], dtype=np.int64)
    block = compress(by_rank, rank[back], n.astype(np.int32), t.astype(np.uint8), doc, valid.astype(np.uint8))
    return {"chunk": key, "bucket": -1, "block": block, "n_words": int(n.sum()), "n_train": int(n[t > 0].sum())}


def make_chunks(chunk_words: int):
    """Rows (doc_id, text, part) as chunks. part: 0 held out from training, 1 training, 2 training but
    deleted for the weights; the last go into chunks of their own, with odd keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 24, 0
        pending = {odd: ([], [], [], []) for odd in (0, 1)}

        def flush(odd: int) -> pa.RecordBatch:
            nonlocal made
            row = _chunk((base + made) * 2 + odd, *pending[odd])
            made += 1
            pending[odd] = ([], [], [], [])
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("block", pa.binary()), ("n_words", pa.int64()), ("n_train", pa.int64())]))

        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            ids, part = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, min(SLICE_BYTES, 2 * chunk_words)):
                h, n = word_hashes(raw, offsets[a : b + 1])
                ends = np.cumsum(n)
                h = np.insert(h, ends, END)
                n = n + 1
                for odd in (0, 1):
                    chosen = (part[a:b] == 2) == bool(odd)
                    if not chosen.any():
                        continue
                    hashes, counts, names, train = pending[odd]
                    hashes.append(h[np.repeat(chosen, n)])
                    counts.append(n[chosen])
                    names.extend(i for i, c in zip(ids[a:b], chosen, strict=True) if c)
                    train.append(part[a:b][chosen])
                    if sum(map(len, hashes)) >= chunk_words:
                        yield flush(odd)
        for odd in (0, 1):
            if pending[odd][1]:
                yield flush(odd)

    return lean(run)


def _read_chunk(block: bytes) -> dict:
    by_rank, ids, n, part, doc, valid = decompress(block)
    h = by_rank[ids]
    return {"words": by_rank, "ids": ids, "h": h, "n": n.astype(np.int64), "part": part, "doc": doc, "valid": valid, "prev": _contexts(h, n.astype(np.int64))}


def make_requests(n_ranges: int):
    """Chunks as blocks (keys of words, their counts, keys of pairs, their counts), one a key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = _read_chunk(block.as_py())
                train = np.repeat(c["part"] > 0, c["n"])
                words, at = np.unique(np.append(c["h"], START), return_inverse=True)
                w_count = np.bincount(at[:-1][train], minlength=len(words)).astype(np.uint32)
                w_count[at[-1]] += np.count_nonzero(c["part"] > 0)
                pairs, at = np.unique(pair_keys(c["prev"], c["h"]), return_inverse=True)
                p_count = np.bincount(at[train], minlength=len(pairs)).astype(np.uint32)
                we, pe = buckets_of(words, n_ranges), buckets_of(pairs, n_ranges)
                rows = [
                    {"chunk": key, "bucket": i, "block": compress(words[we[i] : we[i + 1]], w_count[we[i] : we[i + 1]], pairs[pe[i] : pe[i + 1]], p_count[pe[i] : pe[i + 1]])}
                    for i in range(n_ranges)
                    if we[i] < we[i + 1] or pe[i] < pe[i + 1]
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("block", pa.binary())]))

    return lean(run)


def answer_range(group: pa.Table) -> pa.Table:
    """The sums of one key range for each chunk: of all training text, and of its deleted part."""
    chunks = group.column("chunk").to_numpy()
    blocks = [decompress(b.as_py()) for b in group.column("block")]
    odd = (chunks & 1).astype(bool)
    answers: list[list[np.ndarray]] = [[] for _ in blocks]
    known = 0
    for kind in (0, 2):
        keys = [b[kind] for b in blocks]
        sizes = [len(k) for k in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.concatenate([b[kind + 1] for b in blocks]).astype(np.float64)
        total = np.bincount(at, weights=count, minlength=len(distinct)).astype(np.uint64)
        gone = np.repeat(odd, sizes)
        deleted = np.bincount(at[gone], weights=count[gone], minlength=len(distinct)).astype(np.uint64)
        if kind == 0:
            known = int(np.count_nonzero(total[distinct != START]))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        for i, out in enumerate(answers):
            here = at[edge[i] : edge[i + 1]]
            out.append(total[here])
            if odd[i]:
                out.append(deleted[here])
    out = {"chunk": chunks, "bucket": group.column("bucket"), "block": pa.array([_narrow(a) for a in answers], pa.binary()), "n_known": pa.array([known] + [0] * (len(blocks) - 1), pa.int64())}
    return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("block", pa.binary()), ("n_known", pa.int64())]))


def _narrow(arrays: list[np.ndarray]) -> bytes:
    return compress(*[a.astype(np.uint32) if not len(a) or a.max() < 1 << 32 else a for a in arrays])


def _joined(group: pa.Table) -> tuple[dict, list[np.ndarray]]:
    """A chunk with the sums for its sorted distinct words (with START) and pairs, ranges in order."""
    order = np.argsort(group.column("bucket").to_numpy(), kind="stable")
    blocks = [group.column("block")[int(i)].as_py() for i in order]
    parts = [decompress(b) for b in blocks[1:]]
    return _read_chunk(blocks[0]), [np.concatenate([p[k] for p in parts]).astype(np.float64) for k in range(len(parts[0]))]


def _lookup(c: dict, word_sums: np.ndarray, pair_sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each word, of its context and of the pair."""
    words = np.unique(np.append(c["words"], START))
    of_rank = word_sums[np.searchsorted(words, c["words"])]
    word = of_rank[c["ids"]]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(c["n"]) - c["n"]] = word_sums[np.searchsorted(words, START)]
    _, at = np.unique(pair_keys(c["prev"], c["h"]), return_inverse=True)
    return word, context, pair_sums[at]


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else the bit length of the count, BUCKETS - 1 at most."""
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def tally_held(n_kept: int, vocabulary: int):
    """Tallies of the deleted documents' words by (bucket, pair ratio, word ratio), for EM."""

    def run(group: pa.Table) -> pa.Table:
        c, (w_all, w_gone, p_all, p_gone) = _joined(group)
        word, context, pair = _lookup(c, w_all - w_gone, p_all - p_gone)
        unit = 1.0 / (vocabulary + 1)
        step = lambda p: np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300) / unit)), -10_000).astype(np.int64)
        cells = np.stack([bucket_of(context), step(np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)), step(word / max(n_kept, 1))])
        found, n = np.unique(cells, axis=1, return_counts=True)
        return pa.table({"b": found[0], "p2": found[1], "p1": found[2], "n": n.astype(np.int64)})

    return lean(run)


def learn_weights(cells: np.ndarray, rounds: int = 200, prior: float = 1.0) -> np.ndarray:
    """EM. cells: rows (bucket, pair step, word step, n). Returns weights [bucket, (l2, l1, l0)].

    A bucket without held-out words takes the weights of the nearest lower one, and the
    prior keeps every weight above 0, so that no word gets probability 0.
    """
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    for b in range(BUCKETS):
        own = cells[cells[:, 0] == b]
        if not len(own):
            if b > 1:
                weights[b] = weights[b - 1]
            continue
        ratio = np.where(own[:, 1:3] > -10_000, np.exp2(own[:, 1:3] / STEPS), 0.0)
        p, n = np.column_stack([ratio, np.ones(len(own))]), own[:, 3].astype(float)
        if b == 0:
            p[:, 0] = 0.0
        pad = np.array([prior if b else 0.0, prior, prior])
        for _ in range(rounds):
            share = p * weights[b]
            share /= share.sum(axis=1, keepdims=True)
            new = share.T @ n + pad
            new /= new.sum()
            done = np.abs(new - weights[b]).max() < 1e-7
            weights[b] = new
            if done:
                break
    return weights


def score_chunk(n_train: int, vocabulary: int, weights: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        c, sums = _joined(group)
        word, context, pair = _lookup(c, sums[0], sums[len(sums) // 2])
        lam = weights[bucket_of(context)]
        p = lam[:, 0] * np.divide(pair, context, out=np.zeros_like(pair), where=context > 0) + lam[:, 1] * word / max(n_train, 1) + lam[:, 2] / (vocabulary + 1)
        base = np.log10((word + 0.5) / (n_train + 0.5 * (vocabulary + 1)))
        starts = np.cumsum(c["n"]) - c["n"]
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table(
            {
                "doc_id": pa.array(c["doc"], mask=c["valid"] == 0), "held_out": pa.array(c["part"] == 0), "n_tokens": c["n"],
                "n_known": add((word > 0).astype(np.int64)), "train_tokens": np.full(len(starts), n_train), "base_score": add(base), "score": add(np.log10(p)),
            }
        )

    return lean(run)


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, chunk_words: int = CHUNK_WORDS, range_words: int = RANGE_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each input row.

    held_out: a boolean column of the rows not to learn from; by default those with
    crc32(id as text) mod 5 = 1. Words are lower-cased in A-Z; each text ends with one end
    token, so that null and empty texts have one token. A null id counts as the empty text
    for its checksum and stays null. Repeated rows are learned from and scored each. Without
    training text all counts are 0 and every token has the same score; an empty table gives
    an empty result. Further columns aren't looked at. Ids are integers. A chunk holds whole
    texts, about chunk_words words of them; a longer text is a chunk of its own.
    """
    spark = df.sparkSession
    stage = Staging(spark, "lm")
    crc = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    held = (crc % 5 == 1) if held_out is None else held_out
    part = F.when(held, 0).when(F.pmod(F.xxhash64(crc), F.lit(HELD_EVERY)) == 0, 2).otherwise(1)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), part.cast("int").alias("part"))
    chunks = stage.write(rows.mapInArrow(make_chunks(chunk_words), CHUNK_SCHEMA), "chunks")
    sums = chunks.agg(F.sum("n_words"), F.sum("n_train"), F.sum(F.when(F.col("chunk") % 2 == 1, F.col("n_train")))).first()
    n_words, n_train, n_gone = (x or 0 for x in sums)
    n_ranges = max(4, math.ceil(n_words / range_words))
    requests = chunks.select("chunk", "block").mapInArrow(make_requests(n_ranges), "chunk long, bucket int, block binary")
    answers = requests.groupBy("bucket").applyInArrow(lean(answer_range), "chunk long, bucket int, block binary, n_known long")
    answers = stage.write(answers, "answers")
    vocabulary = answers.agg(F.sum("n_known")).first()[0] or 0
    both = chunks.select("chunk", "bucket", "block").unionAll(answers.select("chunk", "bucket", "block"))
    tallies = both.where("chunk % 2 = 1").groupBy("chunk").applyInArrow(tally_held(n_train - n_gone, vocabulary), "b long, p2 long, p1 long, n long")
    # at most BUCKETS times the squared number of steps, whatever the input
    cells = tallies.groupBy("b", "p2", "p1").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([tuple(r) for r in cells], dtype=np.int64).reshape(-1, 4))
    return both.groupBy("chunk").applyInArrow(score_chunk(n_train, vocabulary, weights), SCORE_SCHEMA)
