"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two texts link when their sets of word shingles overlap by THRESHOLD of their union. A set
of n shingles can only link with sets that share at least T of its shingles, and so one of
any n - T + 1 of them. The join

1. turns texts into sets of 64-bit shingle hashes; texts of equal sets are one class;
2. keeps the classes that share enough of their smallest hashes with others: of the n - T + k
   smallest of two sets that link, k are the same. With k of a tenth of the set, texts that
   have but some common phrases end here;
3. counts, among those, in how many sets each shingle is, and drops classes of which too many
   shingles are in no other set; passages that many texts share end here;
4. brings together classes that are connected by a shared one of their n - T + 1 rarest
   shingles (connected components: nothing that links is ever parted);
5. searches each component by DivideSkip: a class's short inverted lists are merged,
   candidates that reach the required count go on, and long lists are only probed for the
   candidates by binary search. Large components are searched block against block.

Steps 2 and 3 move hashes in packed blocks by key range, see ``tokens``. The result holds
every link; there is no cap anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldrollup.llm.common import Staging, files, id_filter
from fieldrollup.llm.components import components
from fieldrollup.llm.tokens import U, buckets_of, compress, decompress, lean, mix, slices, text_bytes, word_hashes

WORDS, PERCENT = 4, 85
#: Hashes beyond the least prefix that are looked at in step 2, of a hundred of a set.
EXTRA = 10
#: Hashes that one key range should hold, hashes of a packed chunk, classes of a search block.
RANGE_HASHES, CHUNK_HASHES, BLOCK = 1_000_000, 1_000_000, 512
#: Hashes of the small components that one search task should hold.
TASK_HASHES = 100_000
#: A probe costs about as much as this many merged postings.
PROBE_COST = 16
_JOIN = U(0xA24BAED4963EE407)


def least_overlap(n, m, percent: int = PERCENT):
    """Shingles that sets of n and m must share: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    """Of any n shingles, so many contain a shared one if there is a link at all."""
    return n - -(-percent * n // 100) + 1


def extra_prefix(n):
    return n * EXTRA // 100


def least_shared(percent: int = PERCENT) -> str:
    """Of the extended prefix of a set of n, so many are shared if there is a link at all, in SQL.

    The smaller of two sets that link decides, and has at least percent of n.
    """
    return f"1 + ((n * {percent} + 99) div 100) * {EXTRA} div 100"


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, sorted; sizes of the sets), from word hashes."""
    n_docs = len(counts)
    first = np.cumsum(counts) - counts
    n_grams = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    doc = np.repeat(np.arange(n_docs), n_grams)
    at = np.repeat(first, n_grams) + np.arange(len(doc)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
    span = np.minimum(counts, k)[doc]
    value = span.astype(np.uint64)
    for i in range(k):
        more = span > i
        value = np.where(more, value * _JOIN + hashes[np.minimum(at + i, max(len(hashes) - 1, 0))], value) if len(hashes) else value
    value = mix(value)
    order = np.argsort(value)
    order = order[np.argsort(doc[order], kind="stable")]
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=n_docs).astype(np.int64)


def _signatures(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)):
        total = np.concatenate([[U(0)], np.cumsum(mix(sets ^ salt), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out[0], out[1]


def _sets_of(batch_texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = text_bytes(batch_texts)
    for a, b in slices(offsets):
        yield a, b, *shingle_sets(*word_hashes(raw, offsets[a : b + 1]), k)


def _sketch(k: int, percent: int):
    """(doc_id, text) to (doc_id, n, s1, s2, the smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, sizes in _sets_of(batch.column(1), k):
                s1, s2 = _signatures(sets, sizes)
                first = np.cumsum(sizes) - sizes
                blocks = [sets[f : f + prefix_length(n, percent) + extra_prefix(n)].tobytes() if n else b"" for f, n in zip(first.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(s1), pa.array(s2), pa.array(blocks, pa.binary())], ["doc_id", "n", "s1", "s2", "prefix"]
                )

    return lean(run)


def _post_prefixes(n_ranges: int):
    """Rows (s1, prefix) as blocks (keys, numbers of sets, s1 of the sets) by key range."""

    def flush(owners: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        names = np.array(owners, dtype=np.int64).view(np.uint64)
        edge = buckets_of(keys, n_ranges)
        rows = []
        for i in np.flatnonzero(np.diff(edge)):
            used, at = np.unique(owner[edge[i] : edge[i + 1]], return_inverse=True)
            rows.append({"bucket": int(i), "block": compress(keys[edge[i] : edge[i + 1]], at.astype(np.int32), names[used])})
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("block", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, sets, held = [], [], 0
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                owners.append(name)
                sets.append(mix(np.frombuffer(block.as_py(), np.uint64)))  # least hashes are small: evened over the ranges
                held += len(sets[-1])
                if held >= CHUNK_HASHES:
                    yield flush(owners, sets)
                    owners, sets, held = [], [], 0
        if held:
            yield flush(owners, sets)

    return lean(run)


def _shared_counts(n_parts: int):
    """How many keys of a range each set shares with others, as blocks (s1, count) by range of s1."""

    def run(group: pa.Table) -> pa.Table:
        blocks = [decompress(b.as_py()) for b in group.column("block")]
        keys, owner = np.concatenate([b[0] for b in blocks]), np.concatenate([b[2][b[1]] for b in blocks])
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)  # copies of a set count once
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[new], owner[new]
        names, count = np.unique(owner[_shared(keys)], return_counts=True)
        part = ((names >> U(32)) * U(n_parts)) >> U(32)
        begins, ends = _runs(part.astype(np.int64))
        found = [compress(names[a:b], count[a:b].astype(np.int32)) for a, b in zip(begins, ends, strict=True)]
        return pa.table({"part": pa.array(part[begins].astype(np.int64)), "block": pa.array(found, pa.binary())})

    return lean(run)


def _sum_counts(group: pa.Table) -> pa.Table:
    blocks = [decompress(b.as_py()) for b in group.column("block")]
    names, at = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([b[1] for b in blocks]))
    return pa.table({"s1": names.view(np.int64), "shared": total.astype(np.int64)})


def _post(n_ranges: int, column: str, packed: bool):
    """Rows (cid, hashes) as blocks (keys, cids) by key range, one set of blocks a chunk. ``chunk``: first cid."""

    def flush(cids, sets) -> pa.RecordBatch:
        keys = np.concatenate(sets)
        owner = np.repeat(np.array(cids, dtype=np.int64), [len(s) for s in sets])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        edge = buckets_of(keys, n_ranges)
        rows = [{"bucket": i, "chunk": cids[0], "block": compress(keys[edge[i] : edge[i + 1]], owner[edge[i] : edge[i + 1]])} for i in range(n_ranges) if edge[i] < edge[i + 1]]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("block", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, sets, held = [], [], 0
        for batch in batches:
            for cid, block in zip(batch.column("cid").to_pylist(), batch.column(column), strict=True):
                keys = decompress(block.as_py())[0] if packed else np.frombuffer(block.as_py(), np.uint64)
                if len(keys):
                    cids.append(cid)
                    sets.append(keys)
                    held += len(keys)
                if held >= CHUNK_HASHES:
                    yield flush(cids, sets)
                    cids, sets, held = [], [], 0
        if cids:
            yield flush(cids, sets)

    return lean(run)


def _postings(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(keys, cids) of a key range, by key and then by cid."""
    blocks = [decompress(b.as_py()) for b in group.column("block")]
    keys, cids = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
    order = np.lexsort((cids, keys))
    return keys[order], cids[order]


def _shared(keys: np.ndarray) -> np.ndarray:
    """Which keys are equal to a neighbour."""
    out = np.zeros(len(keys), bool)
    same = keys[1:] == keys[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _runs(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values."""
    begins = np.flatnonzero(np.append(np.ones(min(1, len(part)), bool), part[1:] != part[:-1]))
    return begins, np.append(begins[1:], len(part))[: len(begins)]


def _full_sets(k: int):
    """(cid, n, s1, s2, text) to (cid, n, packed set) where the text is one of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for a, b, sets, sizes in _sets_of(batch.column(4), k):
                s1, s2 = _signatures(sets, sizes)
                ok = np.flatnonzero((sizes == want[1][a:b]) & (s1 == want[2][a:b]) & (s2 == want[3][a:b]))
                first = np.cumsum(sizes) - sizes
                blocks = [compress(sets[first[i] : first[i] + sizes[i]]) for i in ok]
                yield pa.RecordBatch.from_arrays([pa.array(want[0][a:b][ok]), pa.array(sizes[ok]), pa.array(blocks, pa.binary())], ["cid", "n", "block"])

    return lean(run)


def _part(cids: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of the classes that each one is in."""
    return (((mix(cids.view(np.uint64)) >> U(32)) * U(n_parts)) >> U(32)).astype(np.int64)


def _frequencies(n_parts: int):
    """How many sets each key of a range is in, told to each class: (keys, frequencies) of two and more."""

    def run(group: pa.Table) -> pa.Table:
        keys, cids = _postings(group)
        begins, ends = _runs(keys)
        often = np.repeat(ends - begins, ends - begins).astype(np.int32)
        keep = often > 1
        keys, cids, often = keys[keep], cids[keep], often[keep]
        part = _part(cids, n_parts)
        order = np.lexsort((keys, cids, part))
        keys, cids, often, part = keys[order], cids[order], often[order], part[order]
        edges, ends = _runs(part)
        blocks = [compress(cids[a:b], keys[a:b], often[a:b]) for a, b in zip(edges, ends, strict=True)]
        return pa.table({"part": pa.array(part[edges], pa.int64()), "block": pa.array(blocks, pa.binary())})

    return run


def _rarest(percent: int):
    """The shared keys of a part's classes, by class: which classes can still link, and their rarest shared keys.

    Blocks come from ``_frequencies``; the set sizes from blocks of (cid, n) pairs of two arrays.
    """

    def run(group: pa.Table) -> pa.Table:
        parts = [decompress(b.as_py()) for b in group.column("block")]
        sizes = [p for p in parts if len(p) == 2]
        posted = [p for p in parts if len(p) == 3]
        schema = pa.schema([("cid", pa.int64()), ("prefix", pa.binary())])
        if not posted or not sizes:
            return schema.empty_table()
        own, n = (np.concatenate([p[i] for p in sizes]) for i in (0, 1))
        order = np.argsort(own)
        own, n = own[order], n[order]
        cids, keys, often = (np.concatenate([p[i] for p in posted]) for i in (0, 1, 2))
        order = np.lexsort((keys, often, cids))
        cids, keys = cids[order], keys[order]
        found, first, shared = np.unique(cids, return_index=True, return_counts=True)
        size = n[np.searchsorted(own, found)]
        alone = size - shared
        # the rarest shingles come first, and those of one set only are the rarest
        take = prefix_length(size, percent) - alone
        ok = np.flatnonzero(take > 0)
        return pa.table({"cid": found[ok], "prefix": pa.array([keys[first[i] : first[i] + min(take[i], shared[i])].tobytes() for i in ok], pa.binary())}, schema=schema)

    return lean(run)


def _spanning(group: pa.Table) -> pa.Table:
    """A forest that connects the classes of each key of a range."""
    keys, cids = _postings(group)
    start = np.ones(len(keys), bool)
    start[1:] = keys[1:] != keys[:-1]
    hub = cids[np.flatnonzero(start)][np.cumsum(start) - 1]
    pairs = np.unique(np.stack([cids, hub], axis=1)[cids != hub], axis=0)
    forest = _forest(pairs)
    return pa.table({"a": forest[:, 0], "b": forest[:, 1]})


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (node, root) with the same components as the pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([(x, root(x)) for x in parent if root(x) != x], dtype=np.int64).reshape(-1, 2)


def search(index: list[np.ndarray], queries: list[np.ndarray] | None, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """T-occurrence search: (query, indexed sets that link with it), each unordered pair once.

    queries None: the index against itself. DivideSkip: a query's inverted lists are ordered
    by length. The shortest n - T + 1 are merged first, as any set that reaches T is in one
    of them. Further lists are merged while they are short for the number of candidates; the
    long rest is probed for each candidate by binary search, dropping those that can't reach
    the required overlap any more. Merging counts set numbers, which are few in a block.
    """
    own = queries is None
    queries = index if own else queries
    sizes = np.array([len(s) for s in index], dtype=np.int64)
    keys = np.concatenate(index)
    member = np.repeat(np.arange(len(index)), sizes)
    order = np.argsort(keys, kind="stable")
    member = member[order]
    distinct, start, length = np.unique(keys[order], return_index=True, return_counts=True)
    code = np.searchsorted(distinct, keys[order]).astype(np.int64) * len(index) + member
    for q, keys_q in enumerate(queries):
        n = len(keys_q)
        place = np.searchsorted(distinct, keys_q)
        place = place[distinct[np.minimum(place, len(distinct) - 1)] == keys_q]
        if not len(place):
            continue
        place = place[np.argsort(length[place], kind="stable")]
        missing = n - len(place)
        least = -(-percent * n // 100)
        head = n - least + 1 - missing
        if head <= 0:
            continue
        lists = lambda at: np.concatenate([member[start[i] : start[i] + length[i]] for i in at]) if len(at) else np.zeros(0, np.int64)
        short, rest = place[:head], place[head:]
        count = np.bincount(lists(short), minlength=len(index))
        candidate = np.flatnonzero(count)
        candidate = candidate[(sizes[candidate] * 100 >= percent * n) & (n * 100 >= percent * sizes[candidate])]
        candidate = candidate[candidate > q] if own else candidate
        if not len(candidate):
            continue
        is_long = length[rest] > PROBE_COST * len(candidate)
        merged, probed = rest[~is_long], rest[is_long]
        if len(merged):
            count = count + np.bincount(lists(merged), minlength=len(index))
        need = least_overlap(n, sizes[candidate], percent)
        have = count[candidate]
        for i, at in enumerate(probed):
            alive = have + (len(probed) - i) >= need
            if not alive.all():
                candidate, need, have = candidate[alive], need[alive], have[alive]
            if not len(candidate):
                break
            wanted = at * len(index) + candidate
            spot = np.searchsorted(code, wanted)
            have = have + (code[np.minimum(spot, len(code) - 1)] == wanted)
        found = candidate[have >= need]
        if len(found):
            yield q, found


def _links(percent: int):
    """A search task: rows (task, comp, side, cid, copies, block) to (cid, root, links)."""

    def run(group: pa.Table) -> pa.Table:
        comp, side = group.column("comp").to_numpy(), group.column("side").to_numpy()
        cid, copies = group.column("cid").to_numpy(), group.column("copies").to_numpy()
        sets = [decompress(b.as_py())[0] for b in group.column("block")]
        pairs, links = [], np.zeros(len(cid), np.int64)
        order = np.lexsort((side, comp))
        for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            if len(rows) < 2:
                continue
            queries = [sets[i] for i in left] if len(right) and len(left) else None
            base = right if queries is not None else rows
            who = left if queries is not None else rows
            for q, found in search([sets[i] for i in base], queries, percent):
                hits = base[found]
                links[hits] += copies[who[q]]
                links[who[q]] += copies[hits].sum()
                pairs.append(np.stack([cid[hits], np.full(len(hits), cid[who[q]])], axis=1))
        forest = _forest(np.concatenate(pairs)) if pairs else np.zeros((0, 2), np.int64)
        root = dict(forest.tolist())
        return pa.table({"cid": cid, "root": np.array([root.get(c, c) for c in cid.tolist()], dtype=np.int64), "links": links})

    return lean(run)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each input row.

    Words are lower-cased in A-Z; a text of fewer words than a shingle is one shingle, and a
    null or empty one, or one without words, has none and links with nothing. component_id:
    the smallest doc_id reachable by links, itself included (null ids only where no other is
    reachable). n_links: other rows that it links with, copies included. Repeated rows are
    copies of each other. An empty table gives an empty result; further columns aren't
    looked at. Ids are integers. A text's shingles are sorted in memory, about 100 bytes a word.
    """
    spark = df.sparkSession
    stage = Staging(spark, "jaccard")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sketched = stage.write(rows.mapInArrow(_sketch(words, percent), "doc_id long, n long, s1 long, s2 long, prefix binary"), "sketched")
    docs = sketched.select("doc_id", "n", "s1", "s2")
    total = sketched.agg(F.count(F.lit(1)), F.sum(F.length("prefix"))).first()
    same = docs.where("n > 0").groupBy("n", "s1", "s2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    classes = stage.write(same.repartition(files(total[0])).withColumn("cid", F.monotonically_increasing_id()), "classes")
    n_ranges = max(4, math.ceil((total[1] or 0) / 8 / RANGE_HASHES))
    posted = sketched.where("n > 0").select("s1", "prefix").mapInArrow(_post_prefixes(n_ranges), "bucket int, block binary")
    shared = posted.groupBy("bucket").applyInArrow(_shared_counts(max(4, math.ceil(total[0] / 50_000))), "part long, block binary")
    shared = shared.groupBy("part").applyInArrow(lean(_sum_counts), "s1 long, shared long").withColumnRenamed("s1", "_s1")
    likely = classes.join(shared, F.col("s1") == F.col("_s1")).where(f"shared >= {least_shared(percent)}")
    chosen = stage.write(likely.select("cid", "n", "s1", "s2", F.col("least").alias("_id")), "likely", total[0])
    blocks = "bucket int, chunk long, block binary"
    wanted = rows.where(id_filter(chosen, "_id")(F.col("doc_id")))
    texts = wanted.join(chosen.hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id"))).select("cid", "n", "s1", "s2", "text")
    sets = stage.write(texts.mapInArrow(_full_sets(words), "cid long, n long, block binary"), "sets")
    n_sets = chosen.count()
    if sets.count() != n_sets:  # ids that several rows bear
        sets = stage.write(sets.dropDuplicates(["cid"]), "distinct_sets")
    n_likely = sets.agg(F.sum("n")).first()[0] or 0
    n_ranges = max(4, math.ceil(n_likely / RANGE_HASHES))
    posted = sets.select("cid", "block").mapInArrow(_post(n_ranges, "block", True), blocks)
    often = posted.groupBy("bucket").applyInArrow(lean(_frequencies(n_ranges)), "part long, block binary")
    sizes = sets.select("cid", "n").mapInArrow(_size_blocks(n_ranges), "part long, block binary")
    rare = stage.write(often.unionAll(sizes).groupBy("part").applyInArrow(_rarest(percent), "cid long, prefix binary"), "rare", n_sets)
    posted = rare.mapInArrow(_post(max(4, n_ranges // 4), "prefix", False), blocks)
    edges = posted.groupBy("bucket").applyInArrow(lean(_spanning), "a long, b long")
    together = stage.write(components(edges, stage, "near", n_sets).select(F.col("node").alias("_node"), F.col("root").alias("comp")), "together", n_sets)
    member = sets.select("cid", "n").join(together, F.col("cid") == F.col("_node")).drop("_node")
    member = member.join(classes.select(F.col("cid").alias("_cid"), "copies"), F.col("cid") == F.col("_cid")).drop("_cid")
    # the sets themselves meet only their tasks
    packed = sets.select(F.col("cid").alias("_cid"), "block").hint("merge")
    work = _tasks(member, n_likely, percent).join(packed, F.col("cid") == F.col("_cid")).drop("_cid")
    found = stage.write(work.groupBy("task").applyInArrow(_links(percent), "cid long, root long, links long"), "found", n_sets)
    if together.groupBy("comp").count().where(F.col("count") > BLOCK).isEmpty():  # no component was searched in parts
        linked = found.select(F.col("cid").alias("node"), "root")
    else:
        linked = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), stage, "linked", n_sets)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    member = classes.join(links.withColumnRenamed("cid", "_cid"), F.col("cid") == F.col("_cid"), "left").drop("_cid")
    member = member.join(linked, F.col("cid") == F.col("node"), "left").select("n", "s1", "s2", "copies", "least", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    member = stage.write(member, "member", total[0])
    least = member.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    member = member.join(least, F.col("root") == F.col("_root")).select(F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "component_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    out = docs.select("doc_id", "n", "s1", "s2").join(member, (F.col("n") == F.col("_n")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _size_blocks(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part = _part(cid, n_parts)
            for own in np.unique(part):
                block = compress(cid[part == own], n[part == own])
                yield pa.RecordBatch.from_arrays([pa.array([int(own)], pa.int64()), pa.array([block], pa.binary())], ["part", "block"])

    return lean(run)


def _tasks(member: DataFrame, n_hashes: int, percent: int) -> DataFrame:
    """(task, side, comp, cid, copies) for the classes (cid, n, comp, copies): many small components
    in one search task, a large one as pairs of its blocks.

    Sets that link have sizes in a ratio of percent at least, so that they are in the same
    step of the sizes' logarithm or in neighbouring ones. Each step of a large component is
    dealt into blocks, and a class goes to the blocks of its own and of both neighbouring
    steps. Side 0 asks side 1, and a block against itself has one side only.
    """
    size = member.groupBy(F.col("comp").alias("_comp")).agg(F.count(F.lit(1)).alias("size"))
    member = member.join(size, F.col("comp") == F.col("_comp")).drop("_comp")
    columns = ["comp", "cid", "copies"]
    n_tasks = max(4, math.ceil(n_hashes / TASK_HASHES))
    small = member.where(F.col("size") <= BLOCK).select(F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(n_tasks)).cast("string")).alias("task"), F.lit(0).alias("side"), *columns)
    # a little wider than the ratio, for the logarithm's rounding
    step = F.floor(F.log(F.col("n")) / (math.log(100 / percent) + 1e-6)).cast("int")
    large = member.where(F.col("size") > BLOCK).withColumn("step", step)
    blocks = large.groupBy("comp", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    # each step's blocks, with those of the steps beside it: one row for each step of a large component
    near = [blocks.select(F.col("comp").alias("_comp"), (F.col("step") + d).alias("_step"), F.struct(F.col("step").alias("to"), "k").alias("aim")) for d in (-1, 0, 1)]
    near = near[0].unionAll(near[1]).unionAll(near[2]).groupBy("_comp", "_step").agg(F.collect_list("aim").alias("aims"))  # three at most
    aimed = large.join(near, (F.col("comp") == F.col("_comp")) & (F.col("step") == F.col("_step"))).drop("_comp", "_step")
    own_k = F.element_at(F.filter("aims", lambda x: x["to"] == F.col("step")), 1)["k"]
    aimed = aimed.withColumn("own", F.pmod(F.xxhash64("cid"), own_k).cast("int"))
    every = F.flatten(F.transform("aims", lambda x: F.transform(F.sequence(F.lit(0), x["k"] - 1), lambda i: F.struct(x["to"].alias("step"), i.alias("own")))))
    aimed = aimed.withColumn("there", F.explode(every)).withColumn("here", F.struct("step", "own"))
    name = lambda x: F.concat_ws(".", x["step"].cast("string"), x["own"].cast("string"))
    pair = F.concat_ws("-", F.col("comp").cast("string"), name(F.least("here", "there")), name(F.greatest("here", "there")))
    return small.unionAll(aimed.select(pair.alias("task"), F.when(F.col("here") <= F.col("there"), 0).otherwise(1).alias("side"), *columns))
