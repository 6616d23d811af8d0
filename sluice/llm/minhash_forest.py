"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every text becomes a set of word shingles, its digest and a signature. Texts with equal sets are one
   class, represented by its smallest doc_id; only representatives go on.
2. Each tree of the forest orders the representatives by its own slice of the signature. Rows next to
   each other that share a prefix of at least LEAST_DEPTH values form a region; a region of more than
   LARGE rows is cut at deeper prefixes, down to the whole slice, and its parts are linked by their first
   rows, so that all that share LEAST_DEPTH values stay together. The orders are range-sorted on the full
   key, so a dense region spreads over tasks like any other rows.
3. Regions over all trees are merged into candidate groups, and links are confirmed on full sets within
   each group. A group of more than BLOCK rows is confirmed block by block together with its leaders (the
   rows whose signatures agree most with the group). Rows that stay outside the group's largest cluster
   then meet all rows of the group that share one of their rarest shingles, as linked rows must (a prefix
   filter, which loses nothing); where that is much of the group, they meet every block of it instead.
4. Confirmed links give the components.

Defined cases: a text that is null or without words has an empty set and links with nothing; a text with
fewer words than a shingle is one shingle; rows that share a doc_id are one node and keep a row each;
rows without a doc_id link with nothing, have no component and are kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._shared import bound_batches, materialise, released, running_order, scratch, unused
from sluice.llm.components import components

#: Trees, values of a tree's key, least shared prefix, rows of a region that is cut deeper.
TREES, DEPTH, LEAST_DEPTH, LARGE = 16, 8, 3, 64
#: Rows of a group that one task confirms, leaders of a larger group.
BLOCK, LEADERS = 512, 16
#: Rows and shingles of a group whose sets are compared as a matrix, columns of it at once.
MATRIX_ROWS, MATRIX_SHINGLES, MATRIX_COLUMNS = 32, 2_000_000, 8192
#: Bits of the counters that order shingles by frequency; equal counters cost time, not links.
COUNTER_BITS = 20
#: Candidates up to this count are sent to every executor instead of shuffling all texts.
BROADCAST_ROWS = 1_000_000

_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

_SIGNED = "doc_id long, n_shingles long, digest binary, signature binary"


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles, A-Z in lower case."""
    words = text.lower().split()  # splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = len(words) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = (out ^ hashed[i : i + size]) * _MIX[i % 3]
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(30))) * _MIX[3]
    out = (out ^ (out >> np.uint64(27))) * _MIX[4]
    return np.unique(out ^ (out >> np.uint64(31)))


def signature(found: np.ndarray) -> bytes:
    """The least value of each hash function, big-endian so that bytes sort like the values."""
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), 1024):
        part = (found[at : at + 1024, None] * _MULTIPLY + _ADD) >> np.uint64(32)
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype(">u4").tobytes()


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), n)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    return run


def _common(a: bytes, b: bytes) -> int:
    """Values that two keys share from their start."""
    if a == b:
        return len(a) // 4
    return next(i for i in range(0, len(a), 4) if a[i : i + 4] != b[i : i + 4]) // 4


def regions(keys: list[bytes], first: int, last: int, depth: int) -> Iterator[tuple[int, int, int]]:
    """(first, end, depth) of the regions in sorted keys[first:last], which share `depth` values."""
    waiting = [(first, last, depth)]
    while waiting:
        a, b, d = waiting.pop()
        if b - a < 2:
            continue
        if b - a <= LARGE or d >= DEPTH:
            yield a, b, d
            continue
        at = a
        for i in range(a + 1, b + 1):
            if i == b or _common(keys[i - 1], keys[i]) < d + 1:
                waiting.append((at, i, d + 1))
                at = i


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the sorted orders: links to the first row of each region and of all that it was cut from, and the range's two ends."""
    names = ["kind", "tree", "key", "a", "b"]
    types = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    keys, nodes, tree, ends, rows = [], [], None, [], []

    def flush():
        to = [0] * len(keys)
        for a, b, _ in regions(keys, 0, len(keys), LEAST_DEPTH):
            to[a + 1 : b] = [a] * (b - a - 1)
        rows.extend((0, tree, None, nodes[i], nodes[j]) for i, j in enumerate(to) if nodes[i] != nodes[j])
        if keys:
            ends.append((1, tree, keys[0], nodes[0], None))
            ends.append((2, tree, keys[-1], nodes[-1], None))

    for batch in batches:
        for t, key, node in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if keys and (t != tree or key[: 4 * LEAST_DEPTH] != keys[-1][: 4 * LEAST_DEPTH]):
                flush()
                ends = [*ends[:1], ends[-1]] if ends else ends
                keys, nodes = [], []
            tree = t
            keys.append(key)
            nodes.append(node)
        yield table(rows)
        rows = []
    flush()
    yield table([*rows, *([ends[0], ends[-1]] if ends else [])])


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the members of every region, from classes(node, signature)."""
    slices = F.array(*(F.substring("signature", 4 * DEPTH * t + 1, 4 * DEPTH) for t in range(TREES)))
    rows = classes.select("node", F.posexplode(slices).alias("tree", "key")).select("tree", "key", "node")
    order = ["tree", "key", "node"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = materialise(ranged.mapInArrow(released(_walk), "kind int, tree int, key binary, a long, b long"), "forest")
    # two rows per range: the last of one and the first of the next may belong to one region
    ends = walked.where("kind > 0")
    before = Window.partitionBy("tree").orderBy("key", "a", "kind")
    shared = F.substring("key", 1, 4 * LEAST_DEPTH)
    joined = ends.select("a", F.lag("a").over(before).alias("b"), shared.alias("shared"), F.lag(shared).over(before).alias("old")).where("shared = old")
    return walked.where("kind = 0").select("a", "b").unionByName(joined.where("a != b").select("a", "b"))


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets are alike enough; their sizes alone may rule it out."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def _alike(some: list[np.ndarray], others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of `some` sets are alike enough to which of `others`, all at once."""
    lengths = np.array([len(x) for x in (*some, *others)])
    _, column, counts = np.unique(np.concatenate([*some, *others]), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(len(lengths)), lengths)[counts[column] > 1], (np.cumsum(counts > 1) - 1)[column[counts[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(some), len(others)), np.int64)
    for low in range(0, column[-1] + 1 if len(column) else 0, MATRIX_COLUMNS):
        a, b = np.searchsorted(column, [low, low + MATRIX_COLUMNS])
        cells = np.zeros((len(lengths), min(MATRIX_COLUMNS, column[-1] + 1 - low)), np.float32)
        cells[row[a:b], column[a:b] - low] = 1
        both += (cells[: len(some)] @ cells[len(some) :].T).astype(np.int64)
    return (both > 0) & (den * both >= num * (lengths[: len(some), None] + lengths[len(some) :] - both))


def _confirm(n: int, num: int, den: int, keys: int):
    """Rows sorted by group: links that span each group's clusters, as (node, cluster's first node)."""

    def spanning(group: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        sets = [own for _, own in group]
        alike = _alike(sets, sets, num, den)
        left = np.ones(len(group), bool)
        for first in range(len(group)):
            ahead = np.array([first] if left[first] else [], int)
            left[ahead] = False
            while len(ahead):
                ahead = np.flatnonzero(alike[ahead].any(axis=0) & left)
                left[ahead] = False
                yield from ((group[i][0], group[first][0]) for i in ahead if group[i][0] != group[first][0])

    def links(group: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        if MATRIX_ROWS < len(group) <= 4 * BLOCK and sum(len(own) for _, own in group) <= MATRIX_SHINGLES:
            yield from spanning(group)
            return
        clusters: list[list[tuple[int, np.ndarray]]] = []
        for node, own in group:
            mine = [(node, own)]
            rest = []
            for cluster in clusters:
                for other, theirs in cluster:
                    if other == node or _linked(own, theirs, num, den):
                        break
                else:
                    rest.append(cluster)
                    continue
                if cluster[0][0] != node:
                    yield node, cluster[0][0]
                mine = cluster + mine
            clusters = [*rest, mine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None
        for batch in batches:
            out = []
            fields = [batch.column(i).to_pylist() for i in range(keys)]
            for *here, node, text in zip(*fields, batch.column(keys).to_pylist(), batch.column(keys + 1), strict=True):
                if here != key:
                    out += links(group)
                    group, key = [], here
                group.append((node, shingles(text.as_py(), n)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = list(links(group))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def confirmed_edges(groups: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links that span the true components, from groups(node, component) and texts(node, text)."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    small = groups.join(sizes, "component")
    texts = texts.join(F.broadcast(small) if groups.count() <= BROADCAST_ROWS else small, "node")
    texts = materialise(texts.select("component", "size", "node", "text"), "members")

    def confirm(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
        sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order, "node").select(*keys, "node", "text")
        return sorted_rows.mapInArrow(released(_confirm(n, num, den, len(keys))), "a long, b long")

    found = materialise(confirm(texts.where(F.col("size") <= BLOCK), ["component"]), "links")
    large = texts.where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    if large.isEmpty():
        return found
    return found.unionByName(_confirm_large(large, n, num, den, confirm))


def _cross(n: int, num: int, den: int, keys: int):
    """Rows sorted by group and whether they ask: links of those that ask to the clusters of the others."""

    def links(asking: list, others: list) -> Iterator[tuple[int, int]]:
        sets, theirs = ([own for *_, own in rows] for rows in (asking, others))
        if asking and others and MATRIX_ROWS**2 < len(asking) * len(others) and len(asking) + len(others) <= 4 * BLOCK and sum(map(len, sets)) + sum(map(len, theirs)) <= MATRIX_SHINGLES:
            for (node, cluster, _), found in zip(asking, _alike(sets, theirs, num, den), strict=True):
                yield from ((node, c) for c in {others[i][1] for i in np.flatnonzero(found)} if c != cluster)
            return
        for node, cluster, own in asking:
            met = {cluster}
            for _, c, set_ in others:
                if c not in met and _linked(own, set_, num, den):
                    met.add(c)
                    yield node, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, key = ([], []), None
        for batch in batches:
            out = []
            fields = [batch.column(i).to_pylist() for i in range(keys + 3)]
            for *here, other, node, cluster, text in zip(*fields, batch.column(keys + 3), strict=True):
                if here != key:
                    out += links(*groups)
                    groups, key = ([], []), here
                groups[other].append((node, cluster, shingles(text.as_py(), n)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = list(links(*groups))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _count(n: int):
    """Texts: how many sets have a shingle of each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, _counter(shingles(text.as_py(), n)), 1)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["counter", "n"])

    return run


def _rarest(n: int, num: int, den: int, counts):
    """component, node, text: the rarest shingles of each set, so many that two linked sets share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in batch.column(2):
                found = shingles(text.as_py(), n)
                order = np.lexsort((found, counts.value[_counter(found)]))
                parts.append(found[order[: len(found) + num * len(found) // -den + 1]].view(np.int64))
            rows = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.concatenate(parts))], names=["component", "node", "shingle"])

    return run


def _confirm_large(large: DataFrame, n: int, num: int, den: int, confirm) -> DataFrame:
    """Links within groups of more than BLOCK rows."""
    signed = materialise(large.select("node", F.col("text")).mapInArrow(released(_sign(n)), _SIGNED).select(F.col("doc_id").alias("node"), "signature"), "signed")
    values = large.select("component", "node").join(signed, "node").select("component", "node", F.posexplode(F.array(*(F.substring("signature", 4 * DEPTH * t + 1, 4) for t in range(TREES)))).alias("tree", "value"))
    common = materialise(values.groupBy("component", "tree", "value").agg(F.count(F.lit(1)).alias("agree")), "common")  # written, so that the join's sides are dealt out by themselves and a frequent value can be split
    rated = values.join(common, ["component", "tree", "value"]).groupBy("component", "node").agg(F.sum("agree").alias("agree"))
    best = rated.groupBy("component", F.pmod(F.xxhash64("node"), F.lit(LEADERS))).agg(F.max(F.struct("agree", "node")).alias("best"))
    leaders = materialise(best.select("component", F.col("best.node").alias("node"), (-F.col("best.agree")).alias("rank")), "leaders")

    own = large.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    lead = large.join(leaders, ["component", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["component", "block", "rank", "node", "text"]
    rows = own.withColumn("rank", F.lit(0).cast("long")).select(columns).unionByName(lead.select(columns))
    first = materialise(confirm(rows, ["component", "block"], "rank"), "links")

    cluster = large.select("component", "node", "blocks").join(components(first).withColumnRenamed("component", "cluster"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    counts = cluster.groupBy("component", "cluster").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("component").agg(F.max(F.struct("n", "cluster")).alias("main")).select("component", F.col("main.cluster").alias("main"))
    outside = materialise(cluster.join(main, "component").where("cluster != main").select("component", "node"), "outside")
    if outside.isEmpty():
        return first
    asking = large.join(outside.select("component").distinct(), "component", "left_semi")
    rows = materialise(asking.join(cluster.select("component", "node", "cluster").distinct(), ["component", "node"]).select("component", "blocks", "node", "cluster", "text"), "clustered")

    def cross(found: DataFrame, keys: list[str]) -> DataFrame:
        sorted_rows = found.repartition(*keys).sortWithinPartitions(*keys, "other", "node").select(*keys, "other", "node", "cluster", "text")
        return materialise(sorted_rows.mapInArrow(released(_cross(n, num, den, len(keys))), "a long, b long"), "links")

    # what shares one of the rarest shingles with a row outside
    counted = rows.select("text").mapInArrow(released(_count(n)), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[counted["counter"].to_numpy()] = counted["n"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    rarest = materialise(rows.select("component", "node", "text").mapInArrow(released(_rarest(n, num, den, shared)), "component long, node long, shingle long"), "rarest")
    sizes = rarest.groupBy("component", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own_sizes = materialise(rarest.join(outside, ["component", "node"], "left_semi").join(sizes, ["component", "shingle"]), "shared")
    most = F.lit(LARGE) + 2 * F.col("blocks")  # a chunk and a block bring about two texts of each block to a row
    met = own_sizes.groupBy("component", "node").agg(F.sum("n").alias("met")).join(rows.select("component", "node", "blocks").distinct(), ["component", "node"])
    met = materialise(met.select("component", "node", (F.col("met") > most).alias("dense")), "met")

    few = own_sizes.join(met.where(~F.col("dense")), ["component", "node"]).select("component", "shingle", F.col("node").alias("asker"))
    pairs = few.join(rarest, ["component", "shingle"]).where("node != asker").select("component", "asker", "node").distinct()
    pairs = materialise(pairs, "pairs")
    texts = rows.select("component", "node", "cluster", "text")
    both = pairs.select("component", "asker", "node", F.lit(1).alias("other")).unionByName(pairs.select("component", "asker", F.col("asker").alias("node"), F.lit(0).alias("other")).distinct())
    found = first.unionByName(cross(both.join(texts, ["component", "node"]), ["component", "asker"]))

    # each chunk of the rest of them meets each block of its group
    dense = met.where("dense").select("component", "node")
    if dense.isEmpty():
        return found
    chunks = materialise(dense.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")), "chunks")
    dealt = rows.join(chunks, "component")
    ask = dealt.join(dense, ["component", "node"], "left_semi").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(11)), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other", F.lit(0))
    against = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("other", F.lit(1))
    columns = ["component", "block", "chunk", "other", "node", "cluster", "text"]
    return found.unionByName(cross(ask.select(columns).unionByName(against.select(columns)), ["component", "block", "chunk"]))


def near_duplicates(documents: DataFrame, n: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for documents(doc_id, text).

    Linked are documents with den * |intersection| >= num * |union| of their n-word shingle sets.
    """
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    signed = materialise(rows.mapInArrow(released(_sign(n)), _SIGNED), "signed")
    usable = signed.where("digest is not null and doc_id is not null")
    classes = materialise(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "signature")).alias("x")).select("digest", F.col("x.doc_id").alias("node"), F.col("x.signature").alias("signature")), "classes")
    groups = components(candidate_edges(classes.select("node", "signature")))
    links = confirmed_edges(groups, rows.withColumnRenamed("doc_id", "node"), n, num, den)
    same_id = usable.join(classes.select("digest", "node"), "digest").where("doc_id != node")
    shared = same_id.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).join(classes.select(F.col("node").alias("a")).distinct(), "a", "left_semi")  # ids that stand for another class too
    found = components(links.unionByName(shared))
    own = signed.join(classes.select("digest", "node"), "digest", "left").join(found, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id.

    A document is its doc_id and text: rows equal in both are one document, of which one row stays; rows that
    share a doc_id but not their text are documents of their own, in the order of their texts' hashes. Rows
    without a doc_id all stay.
    """
    spark = documents.sparkSession
    d, h, node = unused(documents, "_d", "_h", "_node")
    keyed = documents.withColumns({d: F.col("doc_id").cast("long"), h: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    with scratch(spark) as keep:
        ids = materialise(keyed.where(F.col(d).isNotNull()).groupBy(d, h).agg(F.count(F.lit(1)).alias("n")), "ids")
        shared = not ids.groupBy(d).agg(F.sum("n").alias("n")).where("n > 1").isEmpty()
        if not shared:
            found = near_duplicates(documents, n, num, den)
            dropped = keep(materialise(found.where(~F.col("kept")).select(F.col("doc_id").alias(d)), "dropped"))
        else:
            numbered = running_order(ids, [F.col(d), F.col(h)], F.lit(1), "numbers").withColumnRenamed("_before", node)
            numbered = materialise(numbered.select(d, h, node), "numbers")
            rows = keyed.select(d, h, "text").dropDuplicates([d, h]).join(numbered, [d, h]).select(F.col(node).alias("doc_id"), "text")
            found = near_duplicates(rows, n, num, den).where(~F.col("kept"))
            dropped = keep(materialise(numbered.join(found.select(F.col("doc_id").alias(node)), node).select(d, h), "dropped"))
    gone = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    left = keyed.join(gone, [d, h] if shared else d, "left_anti")
    if shared:
        left = left.where(F.col(d).isNotNull()).dropDuplicates([d, h]).unionByName(left.where(F.col(d).isNull()))
    return left.select(documents.columns)
