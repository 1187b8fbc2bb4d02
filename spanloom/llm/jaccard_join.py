"""N-gram Jaccard join: MinHash LSH forest and exact verification.

Every document's shingle set gets a label for each of several trees: its min-hashes there, a few bits
each, one after the other. Labels sorted within a node are a prefix trie. Pairs meet at their longest
common prefix over all trees and are verified on their whole shingle sets once, there. Prefixes are
shortened level by level from the full depth: after each level the recall so far is measured on the
verified pairs, whose chance of having met at that depth follows from their exact similarity, and the
search ends once it reaches the target. The shortest prefix is the one at which even pairs at the threshold
itself meet with the target recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import textscan
from spanloom.llm.components import components
from spanloom.llm.runtime import checkpointed, partitions, text_chunks, texts_of

#: Trees, min-hashes of a label, and bits of each in it.
TREES, FULL_DEPTH, BITS = 20, 6, 10
#: Members of a trie node that one task compares at once; larger nodes are cut into pairs of chunks.
BLOCK = 1024
SIGNATURE_SCHEMA = "doc_id long, tk long, n_shingles long, k1 long, k2 long, trees array<long>"


def chance(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """Probability that two sets of the similarity share a prefix of the depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, target: float, trees: int = TREES, full: int = FULL_DEPTH) -> int:
    """The shortest prefix that is ever needed: the longest, from ``full`` down, at which pairs at the threshold meet with the target recall."""
    depth = full
    while depth > 1 and chance(threshold, depth, trees) < target:
        depth -= 1
    return depth


def below(depth: int) -> int:
    """Bits of a label below its prefix of the depth."""
    return BITS * (FULL_DEPTH - depth)


def shingles(flat: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and the documents' offsets among them.

    A text of fewer than n words, but some, has the sequence of all its words as its one shingle.
    """
    start, end, word_at = textscan.words(flat, at)
    hashes = textscan.segment_hashes(flat, start, end)
    gram, whole = textscan.gram_hashes(hashes, word_at, n)
    doc = textscan.doc_of(word_at)
    keys, docs = [gram[whole]], [doc[whole]]
    count = np.diff(word_at)
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            gram, _ = textscan.gram_hashes(hashes, word_at, size)
            with np.errstate(over="ignore"):
                keys.append(textscan.mix64(gram[word_at[short]] + np.uint64(size)))
            docs.append(short)
    key, of = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[fresh], of[fresh]
    return key, np.searchsorted(of, np.arange(len(at)))


def signatures(key: np.ndarray, at: np.ndarray, trees: int = TREES) -> np.ndarray:
    """The label of each document in each tree; documents without shingles get zeros."""
    out = np.zeros((len(at) - 1, trees), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    at = at[:-1][full]
    factors = textscan.keys64(trees * FULL_DEPTH, 97)
    with np.errstate(over="ignore"):
        for tree in range(trees):
            label = np.zeros(len(full), np.uint64)
            for k in range(FULL_DEPTH):
                least = np.minimum.reduceat((key * factors[tree * FULL_DEPTH + k]) >> np.uint64(16), at)
                label = (label << np.uint64(BITS)) | (textscan.mix64(least) >> np.uint64(64 - BITS))
            out[full, tree] = label
    return out


def set_keys(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each document's set."""
    with np.errstate(over="ignore"):
        sums = []
        for seed in (3, 5):
            total = np.concatenate([[np.uint64(0)], np.cumsum(textscan.mix64(key ^ textscan.keys64(1, seed)[0]), dtype=np.uint64)])
            sums.append(textscan.mix64(total[at[1:]] - total[at[:-1]]))
    return sums[0], sums[1]


def signature_table(docs: DataFrame, n: int) -> DataFrame:
    """SIGNATURE_SCHEMA for each row of ``docs`` (doc_id, text, tk)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            key, own = shingles(flat, at, n)
            k1, k2 = set_keys(key, own)
            tree = signatures(key, own)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tree.size + 1, TREES, dtype=np.int32)), pa.array(tree.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(np.diff(own).astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists], names=["doc_id", "tk", "n_shingles", "k1", "k2", "trees"])

    return docs.mapInArrow(scan, SIGNATURE_SCHEMA)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of rows with equal keys, several runs at once, from rows sorted by the keys."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        same = np.ones(table.num_rows - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            same &= v[1:] == v[:-1]
        cut = np.flatnonzero(~same)
        low = cut[-1] + 1 if len(cut) else 0
        if low:
            yield table.slice(0, low).combine_chunks()
        rest = table.slice(low)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


KEY = ("tree", "node", "c1", "c2")


def heads_of(table: pa.Table, prefix: int | None = None) -> np.ndarray:
    """Whether each row, sorted by KEY and label, begins a block (or, with ``prefix``, a trie node of that depth in a block)."""
    head = np.zeros(table.num_rows, bool)
    head[:1] = True
    for c in KEY:
        v = table.column(c).to_numpy()
        head[1:] |= v[1:] != v[:-1]
    if prefix is not None:
        v = table.column("label").to_numpy() >> below(prefix)
        head[1:] |= v[1:] != v[:-1]
    return head


def node_pairs(table: pa.Table, least: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows whose longest common prefix over all trees is in this tree (the first such) and of depth ``least`` or more,
    the prefix's depth, and the rows' trie nodes of depth ``least``.

    A block of two chunks pairs rows of one with rows of the other only.
    """
    n = table.num_rows
    head = heads_of(table, least)
    block = np.cumsum(head) - 1
    starts = np.append(np.flatnonzero(head), n)
    # each row is paired with those after it in its trie node
    after = starts[block + 1] - np.arange(n) - 1
    a = np.repeat(np.arange(n), after)
    first = np.concatenate([[0], np.cumsum(after)])
    b = a + 1 + np.arange(len(a)) - first[a]
    chunk, cross = table.column("chunk").to_numpy(), table.column("c1").to_numpy() != table.column("c2").to_numpy()
    keep = ~cross[a] | (chunk[a] != chunk[b])
    a, b = a[keep], b[keep]
    label, tree = table.column("label").to_numpy(), table.column("tree").to_numpy()
    depth = np.full(len(a), least)
    for d in range(least + 1, FULL_DEPTH + 1):
        depth[(label[a] >> below(d)) == (label[b] >> below(d))] = d
    trees = np.asarray(table.column("trees").combine_chunks().flatten()).reshape(n, -1)
    for t in range(trees.shape[1]):
        # a prefix as long in an earlier tree, or a longer one in a later tree, meets the pair instead
        rival = depth + (t > tree[a])
        beaten = (t != tree[a]) & (rival <= FULL_DEPTH) & (((trees[a, t] ^ trees[b, t]) >> (BITS * np.maximum(FULL_DEPTH - rival, 0))) == 0)
        if beaten.any():
            a, b, depth = a[~beaten], b[~beaten], depth[~beaten]
    return a, b, depth, block


def batches_of(table: pa.Table, limit: int = 300_000) -> Iterator[pa.Table]:
    """Slices of whole blocks with at most ``limit`` pairs (or one block)."""
    starts = np.append(np.flatnonzero(heads_of(table)), table.num_rows)
    pairs = np.concatenate([[0], np.cumsum(np.diff(starts) ** 2)])
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(pairs, pairs[low] + limit, side="right")) - 1)
        yield table.slice(starts[low], starts[high] - starts[low]).combine_chunks()
        low = high


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i] (ascending hashes)."""
    if len(a) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    sizes = np.array([len(s) for s in sets])
    ids, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, (1 << 22) // max(1, len(sets)))
    for low in range(0, len(ids), step):
        x, y = np.searchsorted(code, [low, low + step])
        part = np.zeros((len(sets), min(step, len(ids) - low)), np.float32)
        part[row[x:y], code[x:y] - low] = 1
        total += part @ part.T
    return np.rint(total[a, b]).astype(np.int64)


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``tk``, which tells rows of one doc_id apart by their text."""
    return texts_of(docs).withColumn("tk", F.xxhash64(F.coalesce("text", F.lit(""))))


def linked(docs: DataFrame, threshold: float, n: int, target: float) -> DataFrame:
    """A row for each of ``docs`` (doc_id, tk, n_shingles) with its class of equal shingle sets and the class that links connect it to.

    ``rep`` and ``top`` are the least (is_null, doc_id, tk) of either, null for texts without a word; ``links`` counts rows.
    """
    spark, floor = docs.sparkSession, depth_for(threshold, target)
    docs = row_keys(docs)
    table = checkpointed(signature_table(docs, n))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk"))
    sets_of = ["k1", "k2", "n_shingles"]
    classes = checkpointed(table.where("n_shingles > 0").groupBy(*sets_of).agg(least.alias("rep"), F.count("*").alias("copies"), F.first("trees").alias("trees")).withColumn("cid", F.xxhash64(*sets_of)))
    found = classes.select("cid", F.posexplode("trees").alias("tree", "label")).withColumn("node", F.shiftright("label", below(floor)))
    full = found.groupBy("tree", "node").agg(F.count("*").alias("members")).where("members > 1")
    # members of nodes that hold two classes at least
    members = found.join(full, ["tree", "node"]).withColumn("chunks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("chunk", F.pmod("cid", F.col("chunks")).cast("int"))
    listed = members.groupBy("cid").agg(F.collect_list(F.struct("tree", "node", "label", "chunks", "chunk")).alias("nodes"))
    members = listed.join(classes.select("cid", "trees"), "cid").select("cid", "trees", F.explode("nodes").alias("x")).select("cid", "trees", "x.*")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    blocks = members.select("*", other).select("cid", "trees", "tree", "node", "label", "chunk", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, list(KEY)):
            for part in batches_of(whole):
                a, b, depth, _ = node_pairs(part, floor)
                for d in range(floor, FULL_DEPTH + 1):
                    rows = part.take(np.union1d(a[depth == d], b[depth == d])).drop(["trees"])
                    yield from rows.append_column("depth", pa.array(np.full(rows.num_rows, d, np.int32))).to_batches()

    place = "tree int, node long, label long, chunk int, c1 int, c2 int, depth int"
    need = blocks.repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY, "label").mapInArrow(needed, f"cid long, {place}")
    need = need.groupBy("cid").agg(F.collect_list(F.struct(*[x.split()[0] for x in place.split(", ")])).alias("places")).join(classes.select("cid", "rep", "copies", "trees"), "cid")
    # the shingle sets of all that meet anywhere, once
    key = F.coalesce(F.col("doc_id"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none")
    texts = docs.select(*key, "tk", "text")
    wanted = need.select(F.coalesce("rep.doc_id", F.lit(0)).alias("d"), F.col("rep.none").alias("none"), F.col("rep.tk").alias("tk"), "cid", "copies", "trees", "places")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            hashes, own = shingles(flat, at, n)
            packed = [hashes[own[i] : own[i + 1]].tobytes() for i in range(batch.num_rows)]
            names = ["cid", "copies", "trees", "places"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(packed, pa.binary())], names=[*names, "hashes"])

    fields = ", ".join(x.replace(" ", ":").replace("long", "bigint") for x in place.split(", "))
    packed = texts.join(wanted, ["d", "none", "tk"]).select("cid", "copies", "trees", "places", "text").mapInArrow(sets, f"cid long, copies long, trees array<long>, places array<struct<{fields}>>, hashes binary")
    packed = checkpointed(packed)
    depths, links = list(range(FULL_DEPTH, floor - 1, -1)), None
    for level, d in enumerate(depths):

        def verify(batches: Iterator[pa.RecordBatch], d: int = d) -> Iterator[pa.RecordBatch]:
            for whole in groups(batches, list(KEY)):
                for part in batches_of(whole):
                    yield verified(part, threshold, d, depths)

        at = packed.withColumn("places", F.filter("places", lambda x: x["depth"] == d)).where(F.size("places") > 0)  # noqa: B023
        at = at.select("cid", "copies", "trees", "hashes", F.explode("places").alias("x")).select("cid", "copies", "trees", "hashes", "x.*")
        met = checkpointed(at.repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY, "label", "cid").mapInArrow(verify, "cid long, links long, root long, pairs long, odds array<double>"))
        links = met if links is None else links.unionByName(met)
        so_far = links.agg(F.sum("pairs").alias("pairs"), F.sum(F.col("odds")[level]).alias("all")).first()
        if so_far.pairs and so_far.pairs >= target * round(so_far["all"], 6):
            break
    joined = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cid")
    joined = checkpointed(joined.join(classes.select("cid", "rep"), "cid"))
    tops = joined.join(joined.groupBy("root").agg(F.min("rep").alias("top")), "root").select("cid", "top")
    degree = links.groupBy("cid").agg(F.sum("links").alias("links"))
    classes = classes.drop("trees").join(degree, "cid", "left").join(tops, "cid", "left")
    classes = classes.select(*sets_of, "rep", F.coalesce("top", "rep").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return table.drop("trees").join(classes, sets_of, "left").drop("k1", "k2")


def forest_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, target: float = 0.9999) -> DataFrame:
    """Links of every row of ``docs`` to rows with Jaccard similarity of word n-grams >= threshold.

    Returns doc_id, class_id (the smallest doc_id of the rows that links connect), n_links (rows linked
    with it, copies included), rep_id (the smallest doc_id with the same shingle set), n_shingles. Rows with
    equal shingle sets are one class from the start, so copies are never paired. Texts without a word
    (null, empty) link to nothing and are a class each; shorter texts than n words have one shingle.
    Repeated rows are copies, and of texts with one doc_id each counts by itself. Rows of null doc_id take part;
    class_id or rep_id is null where no row of the class has an id. An empty table gives no rows; further
    columns are ignored. Similarity is exact; of all links, ``target`` at least is found in expectation.
    """
    out = linked(docs, threshold, n, target)
    own = lambda c: F.when(F.col("n_shingles") > 0, F.col(f"{c}.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own("top").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own("rep").alias("rep_id"), "n_shingles")


def distinct_documents(docs: DataFrame, threshold: float = 0.8, n: int = 5, target: float = 0.9999) -> DataFrame:
    """The rows of ``docs`` of which one a class of ``forest_join`` stays: that of the smallest doc_id (null last, then by a hash of the text).

    Texts without a word are a class each and all stay. Of repeated rows of one doc_id and text the least by
    all its columns stays, so runs agree. Columns are kept, whatever their names.
    """
    found = linked(docs, threshold, n, target)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    kept = found.where((F.col("n_shingles") == 0) | (F.col("top") == own)).select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none"), "tk", (F.col("n_shingles") == 0).alias("bare")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tk"))
    rows = rows.join(kept, ["d", "none", "tk"])
    one = rows.where("not bare").groupBy("d", "none", "tk").agg(F.min("row").alias("row"))
    return one.select("row").unionByName(rows.where("bare").select("row")).select("row.*")


def verified(part: pa.Table, threshold: float, depth: int, depths: list[int]) -> pa.RecordBatch:
    """Links within the trie nodes of a table whose pairs meet at ``depth``: for each class with one, the rows it links to, the root of
    its local component, the pairs it is first in, and for each of ``depths`` the sum over these of one by their chance to meet there.

    A class that a join has doubled (repeated rows of its doc_id) counts once.
    """
    cid = part.column("cid").to_numpy()
    fresh = heads_of(part, FULL_DEPTH)
    fresh[1:] |= cid[1:] != cid[:-1]
    if not fresh.all():
        part = part.filter(pa.array(fresh)).combine_chunks()
        cid = cid[fresh]
    copies = part.column("copies").to_numpy()
    values = [np.frombuffer(d, np.uint64) for d in part.column("hashes").to_pylist()]
    a, b, met, block = node_pairs(part, depth)
    size = np.array([len(v) for v in values], np.int64)
    close = (met == depth) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
    a, b = a[close], b[close]
    degree, root, pairs, odds = np.zeros(len(cid), np.int64), cid.copy(), np.zeros(len(cid), np.int64), np.zeros((len(cid), len(depths)))
    cuts = np.searchsorted(block[a], np.arange(block[-1] + 2 if len(block) else 1))
    tops = np.searchsorted(block, np.arange(len(cuts)))
    for k in range(len(cuts) - 1):
        x, y = a[cuts[k] : cuts[k + 1]], b[cuts[k] : cuts[k + 1]]
        if not len(x):
            continue
        low, high = tops[k], tops[k + 1] if k + 1 < len(tops) else len(cid)
        shared = overlaps(values[low:high], x - low, y - low)
        union = size[x] + size[y] - shared
        ok = shared >= threshold * union - 1e-9
        x, y, alike = x[ok], y[ok], (shared[ok] / union[ok])
        np.add.at(degree, x, copies[y])
        np.add.at(degree, y, copies[x])
        np.add.at(pairs, x, 1)
        for i, d in enumerate(depths):
            np.add.at(odds[:, i], x, 1 / chance(alike, d))
        while len(x):  # smallest root along the pairs
            least = np.minimum(root[x], root[y])
            old = root.copy()
            np.minimum.at(root, x, least)
            np.minimum.at(root, y, least)
            if (old == root).all():
                break
    has = degree > 0
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, has.sum() * len(depths) + 1, len(depths), dtype=np.int32)), pa.array(odds[has].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(cid[has]), pa.array(degree[has]), pa.array(root[has]), pa.array(pairs[has]), lists], names=["cid", "links", "root", "pairs", "odds"])
