"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots and posted in the inverted files of the
first few. A query reads the files of its own nearest pivots, ranks what it finds by the footrule
distance of the two orders, and reranks by cosine what lies below its threshold. Vectors are dealt into blocks that
hold their own files, so each is moved once a block of queries, whatever the number of files it is in. Pivots, and the share
that is reranked, are fitted on a bounded sample, by recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.runtime import checkpointed, partitions

#: Distinct vectors (those of least hash) that reach the driver: the pivots are of them, and the index is fitted on them.
SAMPLED = 4096
#: Numbers of pivots that are tried, and the nearest of them that a vector is posted under and a query reads.
PIVOTS, POSTED = (512, 256, 128), 12
#: Shares of all vectors that are tried for reranking, the largest with the fewest pivots only; the recall that the sample must reach, and its queries.
RERANKED, AT_LAST, TARGET, TRIALS = (0.0025, 0.005, 0.01, 0.02, 0.04, 0.08), (0.16, 0.32, 0.64, 1.0), 0.95, 96
#: Vectors and queries that meet in one task at most.
FILE_ROWS, QUERY_ROWS = 32_768, 2048


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivots of each row by falling cosine, ties by number."""
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")


def positions(order: np.ndarray) -> np.ndarray:
    """Place of each pivot in each order."""
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :].repeat(len(order), 0), 1)
    return out


def directions(unit: np.ndarray) -> np.ndarray:
    """Places of the unit vectors that don't point where an earlier one does."""
    return np.flatnonzero(~np.tril(unit @ unit.T > 1 - 1e-12, -1).any(1))


@dataclass
class Fit:
    """Pivots, how many of them a vector is posted under, the places of the pivots for each vector of the sample, and the place in
    the order of the sample that a query's threshold is taken at."""

    pivots: np.ndarray
    posted: int
    sample: np.ndarray
    place: int

    def thresholds(self, orders: np.ndarray) -> np.ndarray:
        """For each query's order, the footrule distance at the fitted place among the sample."""
        if self.place >= len(self.sample):
            return np.full(len(orders), np.iinfo(np.int32).max, np.int32)
        return np.array([np.partition(footrules(self.sample, p), self.place)[self.place] for p in positions(orders)], np.int32)


def footrules(places: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Footrule distances of orders, given by the places of the pivots, to one of them."""
    return np.abs(places - one).sum(1, dtype=np.int32)


def fit(sample: np.ndarray, rows: int, k: int) -> Fit:
    """The most pivots, and for these the least share, at which the sample's own queries find TARGET of their k nearest; if none do, the fewest pivots and the largest share.

    Pivots and queries have different directions, so that a large group of copies weighs no more than one vector. Below 512 rows
    there are as many pivots as files of a vector, so that every vector is in all of them.
    """
    unit = sample / np.sqrt((sample * sample).sum(1, keepdims=True))
    own = directions(unit[:2048])
    fresh = unit[own]
    tries = [n for n in PIVOTS if n <= min(rows // 16, len(fresh))] or [min(len(fresh), PIVOTS[-1] if rows >= 512 else POSTED)]
    asked = own[:: max(1, len(own) // TRIALS)]
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -2
    goal = np.sort(score, 1)[:, -min(k, len(unit)) :][:, 0] - 1e-12
    for n in tries:
        order = nearest_pivots(unit, fresh[:n])
        place, posted = positions(order), min(POSTED, n)
        shares = RERANKED + (AT_LAST if n == tries[-1] else ())
        hits = np.zeros((len(shares), 2))
        for i, q in enumerate(asked):
            near = score[i] >= goal[i]
            found = np.isin(order[:, :posted], order[q, :posted]).any(1)
            d = footrules(place, place[q])
            for j, share in enumerate(shares):
                at = max(k, int(np.ceil(share * len(unit))))
                taken = found & (d <= (np.partition(d, at)[at] if at < len(d) else d.max()))
                hits[j] += min(k, (near & taken).sum()), min(k, near.sum())
        good = np.flatnonzero(hits[:, 0] >= TARGET * hits[:, 1])
        if len(good) or n == tries[-1]:
            share = shares[good[0] if len(good) else -1]
            return Fit(fresh[:n], posted, place, max(k, int(np.ceil(share * len(unit)))))
    raise AssertionError


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0)


def search(table: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest found of each row that ``queries`` selects, among all other rows: query_id, rank, vec_id, score.

    Nearness is the largest cosine, in doubles on the vectors as they are; ties go to the smaller id.
    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows of null id; of lengths, the
    one that most vectors of the sample have counts, and vectors of another have no cosine with it. Rows of one id are all
    candidates, but none of them for a query of that id; a query of several vectors has a result for the nearest to any of
    them. Copies are indexed once, by their vector, and stand for the smallest of their ids. All that tie at a
    query's threshold are reranked. An empty table gives no rows; further columns are ignored.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    empty = "query_id long, rank int, vec_id long, score double"
    # a row for each distinct vector with its k + 1 smallest ids: k of them at least are not the query's own
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = checkpointed(rows.select("id", "v").distinct().withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    # fixed in number, of the least hash of distinct vectors and so the same in every run
    sample = members.select("v", "ids", F.xxhash64("v").alias("h")).orderBy("h", "ids").limit(SAMPLED).select("v").collect()
    if not sample:
        return spark.createDataFrame([], empty)
    lengths = [len(r.v) for r in sample]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    rows, members = rows.where(F.size("v") == width), members.where(F.size("v") == width)
    asks = checkpointed(rows.where("q").select("id", "v").distinct())
    n, m = members.count(), asks.count()
    if not m:
        return spark.createDataFrame([], empty)
    index = fit(np.array([r.v for r in sample if len(r.v) == width], np.float64), n, k)
    files = max(-(-n // FILE_ROWS), min(partitions(spark), -(-n // 2048)))
    blocks = -(-m // QUERY_ROWS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = nearest_pivots(vectors(batch.column("v")), index.pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.thresholds(order), pa.int32())], names=[*batch.schema.names, "most"])

    kind = asks.schema["v"].dataType.simpleString()
    asks = asks.repartition(partitions(spark)).mapInArrow(ask, f"id long, v {kind}, most int")
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    members = members.select(deal("ids", files).alias("file"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("ask"), "ids", "v")
    asking = asks.select(F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("part"), deal("id", blocks).alias("block"), F.col("id").alias("query"), F.col("v").alias("w"), "most")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            x, y = vectors(left.column("v").combine_chunks()), vectors(right.column("w").combine_chunks())
            lists = left.column("ids").combine_chunks()
            copies, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            at = np.cumsum(n) - n
            orders, asked = nearest_pivots(x, index.pivots), nearest_pivots(y, index.pivots)
            places, norm = positions(orders), np.sqrt((x * x).sum(1))
            # the inverted files: rows by pivot
            post = orders[:, : index.posted].ravel()
            by = np.argsort(post, kind="stable")
            start = np.searchsorted(post[by], np.arange(len(index.pivots) + 1))
            by //= index.posted
            for a, p, order, v, most in zip(right.column("query").to_numpy(), positions(asked), asked, y, right.column("most").to_numpy(), strict=True):
                hit = np.zeros(len(x), bool)
                for pivot in order[: index.posted]:
                    hit[by[start[pivot] : start[pivot + 1]]] = True
                own = copies[at] == a
                found = np.flatnonzero(hit & ~(own & (n == 1)))
                found = found[footrules(places[found], p) <= most]
                score = (x[found] * v).sum(1) / (norm[found] * np.sqrt((v * v).sum()))
                least = copies[at[found] + own[found]]
                top = np.lexsort((least, -score))[:k]
                ids, score = np.concatenate([copies[at[t] : at[t] + n[t]] for t in found[top]] or [copies[:0]]), np.repeat(score[top], n[found[top]])
                ids, score = ids[ids != a], score[ids != a]
                top = np.lexsort((ids, -score))[:k]
                out.append((np.full(len(top), a), ids[top], score[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = members.groupBy("file", "ask").cogroup(asking.groupBy("part", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
