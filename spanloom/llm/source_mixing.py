"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into hashed blocks. A source's target fixes how often each of its blocks is taken
(whole rounds, then permuted blocks up to the rest). The tree splits the exact block quotas of all
sources among output shards, each leaf draws its blocks from the sources' permuted lists, and documents
are shuffled within their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import textscan
from spanloom.llm.runtime import checkpointed, partitions, text_chunks, texts_of

#: Words of a block, and the most blocks of a source; larger sources have larger blocks.
BLOCK_WORDS, MAX_BLOCKS = 1 << 16, 4096
#: Words of an output shard; at least so many shards.
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS = 1 << 24, 16, 4096
MIX_SCHEMA = "doc_id long, tk long, source string, size long, source_size long, target double, taken long, shards array<int>"


def row_key(text: str, source: str) -> Column:
    """Tells rows of one doc_id apart by what they hold."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(source).cast("string"), F.lit("")), F.col(source).isNull())


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, key ``tk``, source and the number of words of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, at in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "tk", "source")], pa.array(np.diff(textscan.words(flat, at)[2]).astype(np.int64))], names=["doc_id", "tk", "source", "size"])

    return texts_of(docs, "source").withColumn("tk", row_key("text", "source")).mapInArrow(scan, "doc_id long, tk long, source string, size long")


def targets(sizes: list[int], weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> list[float]:
    """Shares of the whole by weight, in order; what exceeds ``cap`` sizes of a source is shared again."""
    total, fixed = float(sum(sizes)), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(fixed.values())
        whole = sum(weights[i % len(weights)] for i in open_)
        share = {i: rest * weights[i % len(weights)] / whole for i in open_}
        above = [i for i in open_ if share[i] > cap * sizes[i]]
        if not above:
            return [float((fixed | share)[i]) for i in range(len(sizes))]
        fixed |= {i: float(cap * sizes[i]) for i in above}


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts (shards x sources) that add up to the quotas; shards get equal totals, to within one.

    Each inner node draws its left part without replacement from what it holds.
    """
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if len(quotas) else quotas
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def plan_blocks(blocks: dict[int, np.ndarray], target: list[float], shards: int, seed: int) -> tuple[list[tuple], dict[int, int]]:
    """Rows (source, block, shards of its copies, boundary) and the words wanted of each source's boundary block.

    ``blocks``: words of each block, by source.
    """
    copies: dict[int, np.ndarray] = {}
    edge: dict[int, tuple[int, int]] = {}
    for s, words in blocks.items():
        size, rng = int(words.sum()), np.random.default_rng([seed, s])
        rounds = min(3, int(target[s] // size)) if size else 1
        copies[s] = np.full(len(words), rounds)
        rest = target[s] - rounds * size if size else 0
        order = rng.permutation(len(words))
        n = int(np.searchsorted(np.cumsum(words[order]), rest, side="right"))
        copies[s][order[:n]] += 1
        left = int(round(rest - words[order[:n]].sum()))
        if n < len(words) and left > 0:
            edge[s] = (int(order[n]), left)
            copies[s][order[n]] += 1
    known = sorted(blocks)
    counts = split_quotas(np.array([int(copies[s].sum()) for s in known], dtype=np.int64), shards, np.random.default_rng([seed, 1 << 20]))
    rows = []
    for k, s in enumerate(known):
        held = np.repeat(np.arange(len(copies[s])), copies[s])
        held = np.random.default_rng([seed, s, 1]).permutation(held)
        shard = np.repeat(np.arange(shards), counts[:, k])
        order = np.argsort(held, kind="stable")
        for block, part in zip(range(len(copies[s])), np.split(shard[order], np.cumsum(copies[s])[:-1]), strict=True):
            rows.append((s, block, [int(x) for x in part], edge.get(s, (-1, 0))[0] == block))
    return rows, {s: left for s, (_, left) in edge.items()}


def planned(sizes: DataFrame, weights: tuple[float, ...], cap: int, shards: int | None, seed: int) -> tuple[DataFrame, int, int]:
    """MIX_SCHEMA for each row of ``sizes`` (doc_id, tk, source, size; checkpointed), the number of shards and of all words."""
    spark = sizes.sparkSession
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    total = sum(r["size"] for r in found)
    shards = shards or min(MOST_SHARDS, max(LEAST_SHARDS, total // SHARD_WORDS))
    if not found:
        return spark.createDataFrame([], MIX_SCHEMA), shards, 0
    target = targets([r["size"] for r in found], weights, cap)
    n_blocks = [max(1, min(MAX_BLOCKS, -(-r["size"] // BLOCK_WORDS))) for r in found]
    named = spark.createDataFrame([(i, r.source, r["size"], t, b) for i, (r, t, b) in enumerate(zip(found, target, n_blocks, strict=True))], "s int, name string, source_size long, target double, n_blocks int")
    placed = sizes.join(named, F.col("source").eqNullSafe(F.col("name"))).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks")).cast("int")).drop("name", "n_blocks")
    words = {s: np.zeros(b, np.int64) for s, b in enumerate(n_blocks)}
    for r in placed.groupBy("s", "block").agg(F.sum("size").alias("words")).collect():
        words[r.s][r.block] = r.words
    rows, wanted = plan_blocks(words, target, shards, seed)
    plan = spark.createDataFrame(rows, "s int, block int, shards array<int>, edge boolean")
    both = placed.join(plan, ["s", "block"])
    whole = both.where(~F.col("edge")).withColumn("taken", F.col("size") * F.size("shards"))
    edge = checkpointed(both.where("edge"))
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in edge.groupBy("s", "size").count().collect():
        counts.setdefault(r.s, []).append((r["size"], r["count"]))
    quotas = spark.createDataFrame([(s, size, n) for s, c in counts.items() for size, n in fitting(c, wanted.get(s, 0))], "s int, size long, fits long")
    # of the documents of one size as many as fit, in the order of a hash; empty ones always do
    order = Window.partitionBy("s", "size").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "tk")
    ranked = edge.where("size > 0").withColumn("n", F.row_number().over(order)).join(quotas, ["s", "size"])
    part = ranked.withColumn("shards", F.when(F.col("n") <= F.col("fits"), F.col("shards")).otherwise(F.expr("slice(shards, 1, size(shards) - 1)")))
    part = part.select(*edge.columns).unionByName(edge.where("size = 0")).withColumn("taken", F.col("size") * F.size("shards"))
    columns = [f.split()[0] for f in MIX_SCHEMA.split(", ")]
    return whole.select(*columns).unionByName(part.select(*columns)), shards, total
def fitting(counts: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """How many documents of each size go into ``room`` words, the largest that still fit first."""
    out = []
    for size, n in sorted(counts, reverse=True):
        taken = min(n, room // size) if size else n
        room -= taken * size
        out.append((size, taken))
    return out


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, shards: int | None = None, seed: int = 17) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): its words, its source's words and target, the
    words taken and the output shard of each copy taken.

    Sources in code-point order, null last, weigh ``weights`` repeating. In a source's one boundary block
    the largest documents that still fit are taken first, so that a source misses its target by less than
    its smallest documents. Null or empty texts have size 0. Rows of one doc_id, or of none, count each. Very long
    texts are counted alone, one at a time. Further columns are ignored. The driver holds the sizes of at most
    MAX_BLOCKS blocks a source, and how often each size occurs in the boundary block, whose number of different sizes grows with the
    root of its words; the number of sources must suit it. Runs agree, whatever the order of rows. An empty table gives no rows.
    """
    return planned(checkpointed(document_sizes(docs)), weights, cap, shards, seed)[0].drop("tk")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, shards: int | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, once for each copy that the mix takes, with all their columns.

    A shard's rows stand together, cut into slices of at most about SHARD_WORDS words, a partition each, and shuffled within
    them. Rows equal in doc_id, text and source are taken equally often, as one item of their common size.
    """
    items = checkpointed(document_sizes(docs).groupBy("doc_id", "tk", "source").agg(F.sum("size").alias("size")))
    mix, shards, total = planned(items, weights, cap, shards, seed)
    slices = max(1, -(-total // (shards * SHARD_WORDS)), -(-partitions(docs.sparkSession) // shards))
    key = F.coalesce(F.col("doc_id"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none")
    taken = mix.select(*key, "tk", F.explode("shards").alias("shard"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none"), row_key("text", "source").alias("tk"))
    out = rows.join(taken, ["d", "none", "tk"]).withColumn("h", F.xxhash64("d", "tk", "shard", F.lit(seed)))
    out = out.withColumn("slice", (F.col("shard") * slices + F.pmod("h", F.lit(slices))).cast("int"))
    return out.repartitionById(shards * slices, "slice").sortWithinPartitions("slice", "h", "d").select("row.*")
