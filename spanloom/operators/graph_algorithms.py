"""Strategies without a relational form: paths, dominators, trees and greedy choice, a trace at a time.

A trace's nodes and edges meet in one row (a trace is a bounded unit) and Arrow batches of traces go to
Python. Every choice between equals goes by the nodes' order.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import numbers, text


class Graph:
    """A trace: nodes by id in order, and the least-cost edge of each pair."""

    def __init__(self, nodes: list[dict], edges: list[dict]):
        self.nodes = {n["node_id"]: n for n in sorted(nodes, key=lambda n: n["ord"])}
        self.keys = list(self.nodes)
        self.order = {k: i for i, k in enumerate(self.keys)}
        self.known: dict[frozenset[int], tuple[dict[int, float], dict[int, int]]] = {}
        self.far: dict[int, dict[int, int]] = {}
        self.forward: bool | None = None
        self.tables: dict[tuple[int, int], dict[int, list[tuple[int, int, int]]]] = {}
        self.out: dict[int, dict[int, float]] = {k: {} for k in self.nodes}
        self.back: dict[int, dict[int, float]] = {k: {} for k in self.nodes}
        for e in edges:
            if e["source"] in self.nodes and e["target"] in self.nodes:
                cost = min(e["cost"], self.out[e["source"]].get(e["target"], e["cost"]))
                self.out[e["source"]][e["target"]] = self.back[e["target"]][e["source"]] = cost

    def anchors(self) -> list[int]:
        """Conclusions in order, or the last node."""
        return [k for k, n in self.nodes.items() if n["type"] == "Conclusion"] or list(self.nodes)[-1:]

    def prize(self, k: int) -> float:
        n = self.nodes[k]
        return n["saliency"] + numbers.PRUNING_BONUS.get(n["type"], 1.0) + (2.0 if n["type"] == "Error" else 0.0)

    def anomalies(self, count: int) -> list[int]:
        """Nodes by falling score; ties by id, last first."""
        return sorted(self.nodes, key=lambda k: (-self.prize(k), -k))[:count]

    def shortest(self, source: int, goals: set[int], banned: set[int] = frozenset(), cut: set[tuple[int, int]] = frozenset()) -> tuple[float, list[int]] | None:
        """Cheapest path to the nearest goal; of equal ones the first in order."""
        heap = [(0.0, (self.order[source],), source, (source,))]
        done: set[int] = set()
        while heap:
            cost, ranks, at, path = heapq.heappop(heap)
            if at in goals:
                return cost, list(path)
            if at in done:
                continue
            done.add(at)
            for to, c in self.out[at].items():
                if to not in done and to not in banned and (at, to) not in cut:
                    heapq.heappush(heap, (cost + c, (*ranks, self.order[to]), to, (*path, to)))
        return None

    def toward(self, goals: frozenset[int]) -> tuple[dict[int, float], dict[int, int]]:
        """Of each node that reaches a goal, the cost of the cheapest way to the nearest one, and the next node on it; found once for the same goals."""
        if goals not in self.known:
            left, after, heap = {}, {}, [(0.0, self.order[k], k, k) for k in goals]
            heapq.heapify(heap)
            while heap:
                cost, _, at, to = heapq.heappop(heap)
                if at not in left:
                    left[at], after[at] = cost, to
                    for k, c in self.back[at].items():
                        if k not in left:
                            heapq.heappush(heap, (cost + c, self.order[k], k, at))
            self.known[goals] = left, after
        return self.known[goals]

    def steps(self, goal: int) -> dict[int, int]:
        """Of each node that reaches a goal, the fewest edges to it; found once."""
        if goal not in self.far:
            far, ring = {goal: 0}, [goal]
            while ring:
                ring = [k for at in ring for k in self.back[at] if k not in far and far.setdefault(k, far[at] + 1)]
            self.far[goal] = far
        return self.far[goal]

    def bound(self, source: int, goals: frozenset[int], banned: set[int], cut: set[int]) -> float | None:
        """No less than the cost of ``detour``, and mostly that: the cheapest known way that is free, else the outcome of a search led by the known ways."""
        left, after = self.toward(goals)
        first = sorted((c + left[k], self.order[k], k) for k, c in self.out[source].items() if k in left and k not in cut and k not in banned and k != source)
        for cost, _, at in first:
            while at not in goals and at not in banned and at != source:
                at = after[at]
            if at in goals:
                return cost
        heap, done = [(cost, self.order[k], cost - left[k], k) for cost, _, k in first], set()
        while heap:
            cost, _, so_far, at = heapq.heappop(heap)
            if at in goals:
                return cost
            if at in done:
                continue
            done.add(at)
            for to, c in self.out[at].items():
                if to in left and to not in done and to not in banned and to != source:
                    heapq.heappush(heap, (so_far + c + left[to], self.order[to], so_far + c, to))
        return None

    def detour(self, source: int, goals: frozenset[int], banned: set[int], cut: set[int]) -> list[int] | None:
        """The path of ``shortest`` beside banned nodes and without a first step that is cut: only nodes are looked at from which the bound can be kept."""
        if source in goals:
            return [source]
        most = self.bound(source, goals, banned, cut)
        if most is None:
            return None
        left, most = self.toward(goals)[0], most + 1e-9 * (1 + most)
        heap, done, order = [(0.0, (self.order[source],), source)], set(), self.order
        while heap:
            cost, ranks, at = heapq.heappop(heap)
            while at not in goals and at not in done:
                done.add(at)
                fresh = [(cost + c, to) for to, c in self.out[at].items() if to in left and cost + c + left[to] <= most and to not in done and to not in banned and not (at == source and to in cut)]
                if len(fresh) != 1 or heap:
                    for c, to in fresh:
                        heapq.heappush(heap, (c, (*ranks, order[to]), to))
                    break
                (cost, at), = fresh
                ranks = (*ranks, order[at])
            if at in goals:
                return [self.keys[i] for i in ranks]
        return None

    def paths(self, source: int, goals: set[int], count: int) -> list[tuple[float, list[int]]]:
        """The cheapest simple paths, in order of cost: each next one leaves an earlier one at some node.

        A detour is looked for when its least cost comes up; before the node where a path left its forerunner all are known.
        """
        goals = frozenset(goals)
        left, _ = self.toward(goals)
        first = self.detour(source, goals, set(), set()) if source in left else None
        cost_of = lambda path: sum(self.out[a][b] for a, b in zip(path, path[1:], strict=False))
        # an entry: cost and order of a path, or the least cost of a detour with what it must not take first; the node of the deviation, what follows the stem on paths found, its cost and nodes
        found, heap, seen = [], [(0.0, [], 0, 0, first, None, {}, 0.0, frozenset())] if first else [], set()
        while heap:
            cost, ranks, _, i, path, cut, here, so_far, before = heapq.heappop(heap)
            if cut is not None:
                before = set(path[:i])
                rest = self.detour(path[i], goals, before, cut)
                path = [*path[:i], *rest] if rest else None
                if path and tuple(path) not in seen:
                    seen.add(tuple(path))
                    heapq.heappush(heap, (cost_of(path), [self.order[k] for k in path], 0, i, path, None, here, so_far, before))
                continue
            found.append((cost if ranks else cost_of(path), path))
            if len(found) == count:
                break
            before = set(before)
            for j in range(i, len(path) - 1):
                k, to = path[j], path[j + 1]
                steps = self.out[k]
                after = here.setdefault(to, {})
                if len(steps) > len(here):
                    least = math.inf
                    for other, c in steps.items():
                        if other in left and c + left[other] < least and other not in here and other not in before:
                            least = c + left[other]
                    if least < math.inf:
                        least += so_far
                        heapq.heappush(heap, (least - 1e-9 * (1 + least), [], len(found) * len(self.keys) + j, j, path, set(here), here, so_far, None))
                before.add(k)
                so_far += steps[to]
                here = after
        return found

    def led(self, source: int, goal: int, count: int) -> list[list[int]]:
        """The cheapest simple paths to one goal, of equal ones the first in order. Costs are whole numbers, so that equal sums are equal. Where all edges lead forward, one pass finds the paths of all nodes."""
        if self.forward is None:
            self.forward = all(self.order[a] < self.order[z] for a, to in self.out.items() for z in to)
        if not self.forward:
            return [path for _, path in self.paths(source, {goal}, count)]
        if (goal, count) not in self.tables:
            # of each node the best continuations: cost, place of the next node and which of its continuations follows; each list is in the order of paths
            best = {goal: [(0, 0, 0)]}
            for k in reversed(self.keys[: self.order[goal]]):
                ways = [(c + step, self.order[to], i) for to, step in self.out[k].items() if to in best for i, (c, _, _) in enumerate(best[to])]
                if ways:
                    ways.sort()
                    best[k] = ways[:count]
            self.tables[goal, count] = best
        best, out = self.tables[goal, count], []
        for _, at, i in best.get(source, ()):
            path = [source]
            while path[-1] != goal:
                path.append(self.keys[at])
                _, at, i = best[path[-1]][i]
            out.append(path)
        return out

    def dominators(self, root: int) -> dict[int, int]:
        """Immediate dominators of what reaches ``root``, on reversed edges, by iteration to a fixed point."""
        post, seen, stack = [], {root}, [(root, iter(sorted(self.back[root], key=self.order.get)))]
        while stack:
            at, more = stack[-1]
            to = next((k for k in more if k not in seen), None)
            if to is None:
                post.append(at)
                stack.pop()
            else:
                seen.add(to)
                stack.append((to, iter(sorted(self.back[to], key=self.order.get))))
        rank = {k: i for i, k in enumerate(post)}
        above, changed = {root: root}, True
        while changed:
            changed = False
            for k in reversed(post[:-1]):
                best = None
                for p in self.out[k]:
                    if p in above:
                        a, b = (p, best) if best is not None else (p, p)
                        while a != b:
                            while rank[a] < rank[b]:
                                a = above[a]
                            while rank[b] < rank[a]:
                                b = above[b]
                        best = a
                if best is not None and above.get(k) != best:
                    above[k], changed = best, True
        return above


class Budget:
    """Nodes taken so far, within a number and a size in characters."""

    def __init__(self, graph: Graph, most: int, room: int):
        self.graph, self.most, self.room, self.taken = graph, most, room, dict.fromkeys(())

    def add(self, keys: list[int]) -> bool:
        """Takes all keys if they fit, else none."""
        fresh = [k for k in dict.fromkeys(keys) if k not in self.taken]
        size = sum(self.graph.nodes[k]["size"] for k in [*self.taken, *fresh])
        if len(self.taken) + len(fresh) > self.most or size > self.room:
            return False
        self.taken |= dict.fromkeys(fresh)
        return True


def k_shortest(g: Graph, b: Budget, sources: int = 12) -> None:
    """The two cheapest paths from each of the foremost anomalies to an outcome, while they fit."""
    goals = g.anchors()
    for k in goals:
        b.add([k])
    for source in g.anomalies(sources):
        for _, path in g.paths(source, set(goals), 2):
            b.add(path)


def dominators(g: Graph, b: Budget) -> None:
    """For each outcome, the dominators between the foremost anomalies and it."""
    for goal in g.anchors():
        b.add([goal])
        above = g.dominators(goal)
        for source in g.anomalies(12):
            if source in above:
                chain = [source]
                while chain[-1] != goal:
                    chain.append(above[chain[-1]])
                b.add(chain)


def steiner(g: Graph, b: Budget) -> None:
    """A tree grown from the outcomes: the prize of a candidate less 0.9 of its way to the tree must be 0.2 at least."""
    for goal in g.anchors():
        b.add([goal])
    both = Graph(list(g.nodes.values()), [])
    for a, to in g.out.items():
        for z, c in to.items():
            for x, y in ((a, z), (z, a)):
                both.out[x][y] = min(c, both.out[x].get(y, c))
    for k in g.anomalies(30):
        way = both.shortest(k, set(b.taken)) if k not in b.taken else None
        if way and g.prize(k) - 0.9 * way[0] >= 0.2:
            b.add(way[1])


def submodular(g: Graph, b: Budget) -> None:
    """Greedy by gain per character: prize and links to what is taken, less likeness to it."""
    words, open_ = {k: set(n["words"]) for k, n in g.nodes.items()}, list(g.nodes)
    likeness = dict.fromkeys(open_, 0.0)
    links = dict.fromkeys(open_, 0)
    for goal in g.anchors():
        b.add([goal])
    reaches = {k for k in open_ if any(x in g.out[k] for x in g.anchors()[:3])}
    fresh = list(b.taken)
    while open_ and len(b.taken) < b.most:
        for t in fresh:
            for k in open_:
                union = len(words[k] | words[t])
                likeness[k] = max(likeness[k], len(words[k] & words[t]) / union if union else 0.0)
                links[k] += (t in g.out[k]) + (k in g.out[t])
        open_ = [k for k in open_ if k not in b.taken]
        gain = lambda k: (g.prize(k) + min(2.0, 0.4 * links[k]) + (1.0 if k in reaches else 0.0) - 0.7 * likeness[k]) / max(20, g.nodes[k]["size"])
        best = max(open_, key=lambda k: (gain(k), -g.order[k]), default=None)
        if best is None:
            return
        open_.remove(best)
        fresh = [best] if b.add([best]) else []


def random_budget(g: Graph, b: Budget) -> None:
    """Nodes in a random order that their ids fix."""
    keys = list(g.nodes)
    seed = int(hashlib.sha256(",".join(map(str, keys)).encode()).hexdigest()[:8], 16)
    random.Random(42 ^ seed).shuffle(keys)
    for k in keys:
        b.add([k])


STRATEGIES: dict[str, Callable[[Graph, Budget], None]] = {"k_shortest": k_shortest, "dominators": dominators, "steiner": steiner, "submodular": submodular, "random_budget": random_budget}
VARIANTS = STRATEGIES | {"k_shortest_10": partial(k_shortest, sources=10)}


def per_trace(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each trace with its nodes and edges, dealt over all shuffle partitions, as what follows is Python work. Of texts only size and words are in it."""
    t = F.coalesce("content", F.lit(""))
    n = nodes.groupBy("trace_id").agg(F.collect_list(F.struct("node_id", "ord", "type", F.length(t).alias("size"), F.array_distinct(text.tokens(t)).alias("words"), "saliency")).alias("nodes"))
    e = edges.select("trace_id", F.struct("source", "target", numbers.edge_cost(F.col("edge_type"), F.col("score")).alias("cost")).alias("e")).groupBy("trace_id").agg(F.collect_list("e").alias("edges"))
    return spread(n.join(e, "trace_id", "left"))


#: Bytes of a batch, as Arrow holds it, that are Python objects at a time; a trace is the least.
PIECE = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of some traces each, so that what Python holds doesn't grow with the rows of a batch."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def of_traces(piece: pa.RecordBatch, column: str) -> list[list[dict]]:
    """The lists of structs of each trace of a piece, none for null; read by fields, which is faster than by rows."""
    lists = piece.column(column)
    flat = lists.flatten()
    names = [f.name for f in flat.type]
    items = iter([dict(zip(names, x, strict=True)) for x in zip(*[f.to_pylist() for f in flat.flatten()], strict=True)])
    return [list(islice(items, n or 0)) for n in pc.list_value_length(lists).to_pylist()]


def spread(traces: DataFrame) -> DataFrame:
    """Traces over as many partitions as the session shuffles to; the adaptive planner would merge small ones."""
    return traces.repartition(int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trace_id")


def prune(nodes: DataFrame, edges: DataFrame, strategy: str, most: int = 80, room: int = 14_000) -> DataFrame:
    """Nodes that a strategy keeps of each trace (trace_id, node_id, place), within the budgets."""
    return prune_all(nodes, edges, {strategy: (strategy, most)}, room).select("trace_id", "node_id", "place")


def prune_all(nodes: DataFrame, edges: DataFrame, wanted: dict[str, tuple[str, int]], room: int = 14_000) -> DataFrame:
    """Nodes that strategies keep (strategy, trace_id, node_id, place), under a name each: its strategy and number of nodes. Traces are gathered and read once for all."""
    for strategy, _ in wanted.values():
        if strategy not in VARIANTS:
            raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(VARIANTS)}")
    choices = [(name, VARIANTS[strategy], most) for name, (strategy, most) in wanted.items()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for trace, nodes, edges in zip(batch.column("trace_id").to_pylist(), of_traces(batch, "nodes"), of_traces(batch, "edges"), strict=True):
                g = Graph(nodes, edges)
                for name, choose, most in choices:
                    b = Budget(g, most, room)
                    choose(g, b)
                    rows += [(name, trace, k, i + 1) for i, k in enumerate(sorted(b.taken, key=g.order.get))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["strategy", "trace_id", "node_id", "place"])

    return per_trace(nodes, edges).mapInArrow(work, "strategy string, trace_id long, node_id long, place int")
