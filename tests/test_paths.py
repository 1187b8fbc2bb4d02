"""Strategies and paths that run a trace at a time, against plain enumeration on small random graphs."""

import hashlib
import itertools
import random

import pytest

from spanloom.operators import graph_algorithms as ga
from spanloom.operators import ranking, strategies, target_paths

TYPES = ("Intent", "Planning", "Action", "Fact", "Conclusion", "Error")
WORDS = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")


def random_trace(seed, n=9, cyclic=True):
    r = random.Random(seed)
    nodes = []
    for k in range(n):
        words = r.sample(WORDS, r.randrange(1, 4))
        nodes.append({"node_id": 10 + k, "ord": k, "type": r.choice(TYPES), "saliency": round(r.uniform(1, 6), 4), "size": r.randrange(5, 60), "words": words, "tool": r.choice(["", "", "search", "editor"]), "doubt": r.choice([0.0, 0.2, 0.4]), "semantic": r.choice([0.0, 0.0, 0.7]),
                      "final_cue": r.random() < 0.2, "final_action": False, "near_failure": r.random() < 0.3, "is_retry": r.random() < 0.2, "is_bridge": r.random() < 0.2, "base_score": r.uniform(2, 9), "cause_type": "other", "step": k // 2})
        nodes[-1]["final_action"] = nodes[-1]["type"] == "Action" and r.random() < 0.3
    edges = []
    for a, b in itertools.permutations(range(n), 2):
        if r.random() < 0.28 and (cyclic and r.random() < 0.3 or a < b):
            kind = r.choice(["Temporal", "Cognitive", "Observation", "Call"])
            edges.append({"source": 10 + a, "target": 10 + b, "edge_type": kind, "confidence": r.choice([0.25, 0.7, 0.85, 0.9]), "dependency": "same_step_neighbor" if kind == "Temporal" else "reasoning", "causal_cost": round(r.uniform(0.1, 3), 6), "plain_cost": round(r.uniform(0.1, 3), 6), "cost": round(r.uniform(0.1, 3), 6)})
    return nodes, edges


def simple_paths(edges, a, b, key):
    """All simple paths from a to b, cheapest first."""
    out, todo = [], [(a,)]
    cost = {(e["source"], e["target"]): e[key] for e in edges}
    while todo:
        path = todo.pop()
        if path[-1] == b:
            out.append((sum(cost[p] for p in itertools.pairwise(path)), list(path)))
            continue
        todo += [(*path, t) for s, t in cost if s == path[-1] and t not in path]
    return sorted(out)


SEEDS = range(25)


@pytest.mark.parametrize("seed", SEEDS)
def test_paths_and_dominators(seed):
    nodes, edges = random_trace(seed)
    g = ga.Graph(nodes, edges)
    keys = list(g.nodes)
    for a, b in ((keys[0], keys[-1]), (keys[2], keys[-2]), (keys[1], keys[5])):
        want = simple_paths(edges, a, b, "cost")[:5]
        assert [p for _, p in g.paths(a, {b}, 5)] == [p for _, p in want]
    root = keys[-1]
    above = g.dominators(root)
    reach = lambda k, without=None: any(without not in p for _, p in simple_paths(edges, k, root, "cost"))
    assert set(above) == {k for k in keys if k == root or reach(k)}
    for k in above:
        strict = {d for d in keys if d not in (k, root) and k != root and not reach(k, d)} | ({root} if k != root else set())
        chain = set()
        while k != root:
            k = above[k]
            chain.add(k)
        assert chain == strict


def cheapest(edges, a, goals):
    both = edges + [{**e, "source": e["target"], "target": e["source"]} for e in edges]
    least = {}
    for e in both:
        key = e["source"], e["target"]
        least[key] = min(e["cost"], least.get(key, 9e9))
    flat = [{"source": s, "target": t, "cost": c} for (s, t), c in least.items()]
    return min((x for goal in goals for x in simple_paths(flat, a, goal, "cost")[:1]), default=None)


@pytest.mark.parametrize("seed", SEEDS)
def test_steiner_by_enumeration(seed):
    nodes, edges = random_trace(seed, 7)
    g = ga.Graph(nodes, edges)
    b = ga.Budget(g, 80, 14_000)
    ga.steiner(g, b)
    taken = set(g.anchors())
    prize = lambda n: n["saliency"] + ga.numbers.PRUNING_BONUS[n["type"]] + 2 * (n["type"] == "Error")
    for n in sorted(nodes, key=lambda n: (-prize(n), -n["node_id"]))[:30]:
        way = cheapest(edges, n["node_id"], taken) if n["node_id"] not in taken else None
        if way and prize(n) - 0.9 * way[0] >= 0.2:
            taken |= set(way[1])
    assert set(b.taken) == taken


@pytest.mark.parametrize("seed", SEEDS)
def test_submodular_and_random_by_replay(seed):
    nodes, edges = random_trace(seed)
    g = ga.Graph(nodes, edges)
    by = {n["node_id"]: n for n in nodes}
    ends = g.anchors()
    b = ga.Budget(g, 6, 200)
    ga.submodular(g, b)
    taken, open_ = [], list(by)
    fits = lambda k: len(taken) < 6 and sum(by[x]["size"] for x in taken) + by[k]["size"] <= 200
    for k in ends:
        if fits(k):
            taken.append(k)
    pairs = {(e["source"], e["target"]) for e in edges}
    like = lambda a, z: len(set(by[a]["words"]) & set(by[z]["words"])) / len(set(by[a]["words"]) | set(by[z]["words"]))
    open_ = [k for k in open_ if k not in taken]
    while open_ and len(taken) < 6:
        gain = lambda k: (g.prize(k) + min(2.0, 0.4 * sum((t, k) in pairs or 0 for t in taken) + 0.4 * sum((k, t) in pairs for t in taken)) + any((k, x) in pairs for x in ends[:3]) - 0.7 * max((like(k, t) for t in taken), default=0)) / max(20, by[k]["size"])
        best = max(open_, key=lambda k: (round(gain(k), 9), -by[k]["ord"]))
        open_.remove(best)
        if fits(best):
            taken.append(best)
    assert set(b.taken) == set(taken)
    b = ga.Budget(g, 4, 120)
    ga.random_budget(g, b)
    keys = list(by)
    random.Random(42 ^ int(hashlib.sha256(",".join(map(str, keys)).encode()).hexdigest()[:8], 16)).shuffle(keys)
    taken = []
    for k in keys:
        if len(taken) < 4 and sum(by[x]["size"] for x in [*taken, k]) <= 120:
            taken.append(k)
    assert list(b.taken) == taken


@pytest.mark.parametrize("seed", SEEDS)
def test_ranking_takes_the_best_of_eight_paths(seed):
    nodes, edges = random_trace(seed)
    got = {r[0]: r for r in ranking.rank_trace([dict(n) for n in nodes], [dict(e) for e in edges])}
    kinds = {n["node_id"]: n["type"] for n in nodes}
    ends = [n["node_id"] for n in nodes if n["type"] == "Conclusion"] or [nodes[-1]["node_id"]]
    info = {(e["source"], e["target"]): e for e in edges}
    for k in list(got):
        best = None
        for goal in ends[::-1][:4]:
            for _, p in simple_paths(edges, k, goal, "causal_cost")[:8] if k != goal else ():
                dep, strength, ratio, idle = ranking.path_quality(p, info, kinds[goal] == "Conclusion")
                if len(p) <= 19 and dep >= 0.55 and strength >= 0.45:
                    best = max(best or (-1,), (dep, strength, ratio, -idle, -len(p)))
        _, _, _, hops, dep, strength, path = got[k]
        assert (dep, strength, -len(path)) == (best[0], round(best[1], 4), best[4]) and hops == len(path) - 1


def reached(edges, k):
    out, todo = set(), [k]
    while todo:
        at = todo.pop()
        for e in edges:
            if e["source"] == at and e["target"] not in out:
                out.add(e["target"])
                todo.append(e["target"])
    return out


@pytest.mark.parametrize("seed", SEEDS)
def test_outcome_pool_and_slice(seed):
    nodes, edges = random_trace(seed)
    by = {n["node_id"]: n for n in nodes}
    t = target_paths.Trail(nodes, edges, target_paths.Limits())
    ends = [k for k, n in by.items() if n["type"] == "Conclusion"]
    acts = [k for k, n in by.items() if n["final_action"]]
    errors = [k for k, n in by.items() if n["type"] == "Error"]
    peers = ends + acts
    last = lambda ks, ps: [k for k in ks if not any(p != k and p in reached(edges, k) for p in ps)]
    late = lambda ks: sorted(ks, key=lambda k: -by[k]["ord"])
    if peers:
        c = last(ends, peers)
        want = [k for k in c if by[k]["final_cue"]] or c or last(acts, peers) or late(peers)[:1]
    else:
        want = last(errors, errors) or errors[-1:] or [nodes[-1]["node_id"]]
    want = late(want)[:4]
    assert t.outcome() == want
    pool = set(want)
    for k in by:
        hit = reached(edges, k) & set(want)
        side = any(e["source"] == k and e["target"] in want or e["target"] == k and e["source"] in want for e in edges)
        if hit or side and by[k]["type"] != "Intent":
            pool.add(k)
    assert t.pool(want) == pool
    # nodes are kept if some walk of kept steps leads from a target to them
    kept, depth = set(want), dict.fromkeys(want, 0)
    changed = True
    while changed:
        changed = False
        for e in edges:
            k, at = e["source"], e["target"]
            if at not in depth:
                continue
            n, sure = by[k], e["confidence"] >= 0.65
            odd = n["near_failure"] or n["is_retry"] or n["is_bridge"] and depth[at] <= 4
            if not (sure or depth[at] < 1 or odd):
                continue
            if k not in kept:
                kept.add(k)
                changed = True
            if (sure or depth[at] >= 1 and odd) and depth[at] + 1 < depth.get(k, 99):
                depth[k] = depth[at] + 1
                changed = True
    assert t.failure_slice(want)[0] == kept


@pytest.mark.parametrize("seed", SEEDS)
def test_chains_differ_and_what_is_kept_fits(seed):
    nodes, edges = random_trace(seed, 10, cyclic=False)
    bound = target_paths.Limits(nodes=6, room=200, context=seed % 2 == 0, coverage=seed % 3)
    t = target_paths.Trail(nodes, edges, bound)
    got = t.select()
    targets = got["targets"]
    assert set(targets) <= set(got["kept"])
    assert t.fits(set(got["kept"])) or set(got["kept"]) == set(targets).union(*(c["path"] for c in got["chains"]))
    for r in got["ranking"]:
        assert r["path"][0] == r["node_id"] and r["path"][-1] == r["target"] in targets and set(r["path"]) <= set(got["kept"])
        assert all(p in t.edge for p in itertools.pairwise(r["path"]))
    scores = [r["score"] for r in got["ranking"]]
    assert scores == sorted(scores, reverse=True) and 0 <= min(scores, default=0) and max(scores, default=0) <= 1.2
    ranked = t.ranking(got["slice"], targets, dict.fromkeys(t.nodes, 4.0))
    covered, chosen = {}, t.distinct_chains(ranked)
    for i, c in enumerate(chosen):
        on = set(itertools.pairwise(c["path"]))
        share = len(on & covered.get(c["target"], set())) / len(on)
        assert c["overlap"] == round(share, 4) and (i == 0 or share <= 0.85)
        covered.setdefault(c["target"], set()).update(on)
    assert len(chosen) <= 5


def test_empty_traces_and_names():
    assert target_paths.Trail([], [], target_paths.Limits()).select()["kept"] == []
    assert strategies.known(("tg_spe", "bm25_retrieval", "tg_spe")) == ("agenttrace_suspicious_paths", "bm25_retrieval")
    with pytest.raises(ValueError, match="unknown pruning strategies: nonsense"):
        strategies.known(("nonsense",))
