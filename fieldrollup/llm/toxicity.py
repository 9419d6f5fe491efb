"""Toxicity by class-conditional Kneser-Ney models.

Two models of the bytes of words, one of toxic and one of ordinary documents: six-grams
that don't cross words. The six-gram counts are those of the class; what a class hasn't
seen backs off to continuation counts that both classes share, so that a rare expression is
judged by the letters that lead to it. A document is compared by its log-likelihood ratio,
normalised by length, over its whole and over its most suspicious run of words, and a
logistic curve fitted on other labelled rows turns that into a score.

The models are fitted on a bounded sample of labelled rows (TRAIN_DOCS of each class and
FIT_DOCS for the curve); every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldrollup.llm.common import text_or_empty, words
from fieldrollup.llm.tokens import U, _tables, lean, slices, text_bytes, word_hashes, word_spans

TRAIN_DOCS, FIT_DOCS = 2000, 4000
ORDER = 6
DISCOUNT = 0.75
#: Words of the run that is looked at beside the whole text.
RUN = 2
#: Bytes of words whose six-grams are looked up at once.
GROUP_BYTES = 1 << 19
LABEL_PARTS = 4
THRESHOLD = 0.3
_LOW48 = U((1 << 48) - 1)


def word_grams(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(six-gram ending at each byte of each word and at the space after it, places at which words begin).

    A six-gram is its bytes, lower-cased in A-Z, in the lower 48 bits, zeros before the word's
    start; the last byte is the lowest.
    """
    n = lengths + 1
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + place
    byte = _tables()[2][data[np.minimum(at, len(data) - 1)]].astype(np.uint64)
    byte[first + lengths] = 32
    gram = byte.copy()
    for k in range(1, ORDER):
        gram[k:] |= np.where(place[k:] >= k, byte[:-k], U(0)) << U(8 * k)
    return gram & _LOW48, first


class Lookup:
    """Values by 48-bit key in a hash table of linear probes, for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 1.5).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(size, np.float32)
        slot, left, step = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            at = (slot[left] + step) & (size - 1)
            free = self.keys[at] == np.iinfo(np.uint64).max
            winner = np.zeros(len(left), bool)
            winner[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
            winner &= free
            self.keys[at[winner]] = keys[left[winner]]
            self.values[at[winner]] = values[left[winner]]
            left = left[~winner]
            step += 1
        self.steps = max(1, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        out, found = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        left, at = np.arange(len(keys)), self._slot(keys)
        for _ in range(self.steps):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            found[left[hit]] = True
            more = ~hit & (there != np.iinfo(np.uint64).max)
            left, at = left[more], (at[more] + 1) & (len(self.keys) - 1)
            if not len(left):
                break
        return out, found


@dataclass
class Model:
    grams: Lookup
    contexts: Lookup

    def _values(self, gram: np.ndarray) -> np.ndarray:
        value, found = self.grams.get(gram)
        rest = np.flatnonzero(~found)
        value[rest] = self.contexts.get(gram[rest] >> U(8))[0]
        return value.astype(np.float64)

    def word_ratios(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: int = GROUP_BYTES) -> np.ndarray:
        """Log-likelihood ratio, toxic over ordinary, of each word; about ``group`` bytes are looked at at once."""
        out, ends, i = np.zeros(len(starts)), np.cumsum(lengths + 1), 0
        while i < len(starts):
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + group, "right"))
            if j > i:
                gram, first = word_grams(data, starts[i:j], lengths[i:j])
                out[i:j] = np.add.reduceat(self._values(gram), first)
                i = j
                continue
            for o in range(0, int(lengths[i]), group):  # a longer word, in parts that see what is before them
                begin, end = max(o - ORDER + 1, 0), min(o + group, int(lengths[i]))
                gram, _ = word_grams(data, starts[i : i + 1] + begin, np.array([end - begin]))
                out[i] += self._values(gram[o - begin : len(gram) - (end < lengths[i])]).sum()
            i += 1
        return out


def _shared_backoff(grams: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Interpolated Kneser-Ney probabilities of the lower orders, from continuation counts of both classes.

    grams: distinct six-grams, of both classes together. Returns by order (grams, p).
    """
    levels = {}
    for order in range(ORDER - 1, 0, -1):
        # a gram of this order continues as many contexts as there are distinct longer grams over it
        shorter = grams & U((1 << (8 * order)) - 1)
        short, count = np.unique(shorter, return_counts=True)
        levels[order] = (short, count.astype(np.float64))
        grams = short
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for order in range(1, ORDER):
        short, count = levels[order]
        context = short >> U(8)
        ctx, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, weights=count)
        kinds = np.bincount(at)
        own = (count - DISCOUNT) / total[at]
        left = DISCOUNT * kinds[at] / total[at]
        if order == 1:
            out[1] = (short, own + left / 256)
        else:
            lower, p = out[order - 1]
            below = short & U((1 << (8 * (order - 1))) - 1)
            out[order] = (short, own + left * p[np.searchsorted(lower, below)])
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, toxic, n) to rows (gram, in toxic, in ordinary) of the words, lower-cased in A-Z."""
    for batch in batches:
        tokens = [w.encode() for w in batch.column(0).to_pylist()]
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        gram, _ = word_grams(np.frombuffer(b"".join(tokens) + b" ", np.uint8), np.cumsum(lengths) - lengths, lengths)
        weight = np.repeat(batch.column(2).to_numpy(), lengths + 1)
        of_toxic = np.repeat(batch.column(1).to_numpy() == 1, lengths + 1)
        types, at = np.unique(gram, return_inverse=True)
        both = [np.bincount(at, weights=weight * chosen, minlength=len(types)).astype(np.int64) for chosen in (of_toxic, ~of_toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(types.view(np.int64)), *map(pa.array, both)], ["gram", "in_toxic", "in_ordinary"])


def fit(types: np.ndarray, in_toxic: np.ndarray, in_ordinary: np.ndarray) -> Model:
    """The two models from sorted six-grams and their counts, as tables of log ratios.

    Where neither class has seen a six-gram, the shared backoff probability cancels out, and
    the ratio is that of the two classes' backoff weights.
    """
    lower, p_lower = _shared_backoff(types)[ORDER - 1]
    shared = p_lower[np.searchsorted(lower, types & U((1 << (8 * (ORDER - 1))) - 1))]
    context, back = np.unique(types >> U(8), return_inverse=True)
    log_p, log_backoff = [], []
    for count in (in_toxic, in_ordinary):
        total = np.bincount(back, weights=count, minlength=len(context))
        kinds = np.bincount(back, weights=count > 0, minlength=len(context))
        backoff = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.maximum(count - DISCOUNT, 0) / np.maximum(total[back], 1)
        log_p.append(np.log(own + backoff[back] * shared))
        log_backoff.append(np.log(backoff))
    return Model(Lookup(types, log_p[0] - log_p[1]), Lookup(context, log_backoff[0] - log_backoff[1]))


def features(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (peak, mean, log of words) for texts: the mean ratio a word of the best run, and of the whole."""
    hashes, n = word_hashes(raw, offsets)
    out = np.zeros((len(n), 3))
    if not len(hashes):
        return out
    starts, lengths = word_spans(raw, offsets)
    _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    ratio = model.word_ratios(raw, starts[one], lengths[one])[back]
    ratio[1:][hashes[1:] == hashes[:-1]] = 0.0  # a word said again says nothing more
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    ends = np.cumsum(n)
    begins = ends - n
    # the best run inside each text; texts of fewer words are one run
    run_end = np.minimum(np.arange(len(ratio)) + RUN, np.repeat(ends, n))
    value = (total[run_end] - total[:-1]) / RUN
    whole = np.flatnonzero(n)
    out[whole, 0] = np.maximum.reduceat(value, begins[whole])
    out[:, 1] = (total[ends] - total[begins]) / np.maximum(n, 1)
    out[:, 2] = np.log1p(n)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps over standardised features: (mean, scale, weights with bias)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _features(model: Model, texts: pa.Array) -> np.ndarray:
    raw, offsets = text_bytes(texts)
    return np.concatenate([features(model, raw, offsets[a : b + 1]) for a, b in slices(offsets)] or [np.zeros((0, 3))])


def _seen(model):
    """Rows (text, toxic) to (toxic, the features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(model.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(x[:, i]) for i in range(3)]], ["toxic", "peak", "mean", "size"])

    return lean(run)


def _scores(model, curve):
    """The score of a text column. Only texts go to the workers; the rows stay in the JVM."""
    mean, scale, w = curve

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            z = (_features(model.value, column) - mean) / scale @ w[:-1] + w[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(run)(texts)

    return F.arrow_udf(score, "double")


def id_part(col: Column) -> Column:
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % LABEL_PARTS


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each input row; with ``carry``, also the
    whole input row as the struct ``row``.

    labels: (doc_id, toxic). Learns only from rows whose crc32(id as text) mod 4 isn't 2: the
    models from parts 0 and 1, the curve from part 3. Null labels are left out, and a row
    labelled twice counts as toxic if any label says so. Null and empty texts get the score
    of a text without words. Null ids stay null and are never learned from; repeated rows
    are scored each; without labels of both classes every score is 0; empty tables give an
    empty result. Further columns aren't looked at, whatever their names.
    """
    spark = docs.sparkSession
    label = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    label = label.withColumn("part", id_part(F.col("doc_id"))).where("part != 2")
    order = F.xxhash64("doc_id")
    train = label.where("part < 2")
    sample = train.where("toxic = 1").orderBy(order).limit(TRAIN_DOCS).unionAll(train.where("toxic = 0").orderBy(order).limit(TRAIN_DOCS))
    sample = sample.unionAll(label.where("part = 3").orderBy(order).limit(FIT_DOCS))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # at most 2 * TRAIN_DOCS + FIT_DOCS ids
    taught = texts.join(F.broadcast(sample.select(F.col("doc_id").alias("_id"), "toxic", "part")), F.col("doc_id") == F.col("_id")).select("text", "toxic", "part")
    lowered = words(F.col("text"))
    counted = taught.where("part < 2").select(F.explode(lowered).alias("word"), "toxic").groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("n"))
    grams = counted.mapInArrow(lean(count_grams), "gram long, in_toxic long, in_ordinary long").groupBy("gram")
    grams = grams.agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_ordinary").alias("in_ordinary")).toArrow()
    types, in_toxic, in_ordinary = (grams.column(c).to_numpy() for c in ("gram", "in_toxic", "in_ordinary"))
    held = (id_part(F.col(f"`{id_col}`")) == 2).alias("held_out")
    names = ["doc_id", *["row"] * carry, "held_out"]
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *whole, held, text_or_empty(text_col).alias("text"))
    if not in_toxic.sum() or not in_ordinary.sum():
        return rows.select(*names, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    order = np.argsort(types)  # grams are below 2**48
    model = fit(types[order].view(np.uint64), in_toxic[order].astype(np.float64), in_ordinary[order].astype(np.float64))
    del grams, types, in_toxic, in_ordinary
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    seen = taught.where("part = 3").select("text", "toxic").mapInArrow(_seen(shared), "toxic int, peak double, mean double, size double").collect()
    x, y = np.array([tuple(r)[1:] for r in seen]).reshape(-1, 3), np.array([r["toxic"] for r in seen])
    if len(set(y.tolist())) < 2:
        curve = (np.zeros(3), np.ones(3), np.array([1.0, 0.0, 0.0, -1.0]))
    else:
        curve = fit_curve(x, y)
    scored = rows.select(*names, _scores(shared, curve)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
