"""Communities: the Leiden method, one clustering a task, and quality, sizes and relabelling as aggregates."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.errors import CommunityNotFound, ConfigurationError
from eventloom.operators.graph import edges_of_lists

UNASSIGNED = -1


class _Level:
    """One aggregation level: the links of each node as a range of two arrays, and strength and size of every node."""

    def __init__(self, row, to, weight, strength, size, objective, resolution, total):
        self.row, self.to, self.weight, self.strength, self.size = row, to, weight, strength, size  # links by row, then by node
        self.start = np.searchsorted(row, np.arange(len(size) + 1)).tolist()
        self.objective, self.resolution, self.total = objective, resolution, total
        self.mass = (strength if objective == "modularity" else size).tolist()
        self.penalty = resolution / total if objective == "modularity" and total else resolution

    def links(self, v: int):
        a, b = self.start[v], self.start[v + 1]
        return zip(self.to[a:b].tolist(), self.weight[a:b].tolist())

    def neighbours(self, v: int) -> list[int]:
        return self.to[self.start[v] : self.start[v + 1]].tolist()

    def best(self, v, group, mass, own):
        """The group among the neighbours' that gains most over ``own``; its gain."""
        toward: dict[int, float] = {}
        for u, w in self.links(v):
            g = group[u]
            toward[g] = toward.get(g, 0.0) + w
        m, penalty = self.mass[v], self.penalty
        stay = toward.get(own, 0.0) - penalty * m * (mass[own] - m)
        best, gain = own, 1e-12
        for g in sorted(toward):
            if g != own and (d := toward[g] - penalty * m * mass[g] - stay) > gain:
                best, gain = g, d
        return best

    def merged(self, part: np.ndarray, n: int) -> _Level:
        """The level whose nodes are the ``n`` parts."""
        row, to = part[self.row], part[self.to]
        between = row != to
        pairs, inverse = np.unique(row[between] * n + to[between], return_inverse=True)
        weight = np.bincount(inverse, self.weight[between], len(pairs))
        sums = (np.bincount(part, x, n) for x in (self.strength, self.size))
        return _Level(pairs // n, pairs % n, weight, *sums, self.objective, self.resolution, self.total)


def _move(level: _Level, group: list[int], rng) -> bool:
    """Queue-based local moving, in place; whether a node moved."""
    n = len(group)
    mass = [0.0] * n
    for v, g in enumerate(group):
        mass[g] += level.mass[v]
    queue = list(range(n))
    rng.shuffle(queue)
    waiting, moved, at = [True] * n, False, 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting[v] = False
        own = group[v]
        to = level.best(v, group, mass, own)
        if to != own:
            mass[own] -= level.mass[v]
            mass[to] += level.mass[v]
            group[v], moved = to, True
            for u in level.neighbours(v):
                if group[u] != to and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    return moved


def _refine(level: _Level, group: list[int], rng) -> list[int]:
    """Well-connected parts of each group: single nodes join a part of their own group while that gains."""
    n = len(group)
    part, mass, alone = list(range(n)), list(level.mass), [True] * n
    total: dict[int, float] = {}
    for v in range(n):
        total[group[v]] = total.get(group[v], 0.0) + level.mass[v]
    of = np.array(group)
    inside = np.bincount(level.row, np.where(of[level.row] == of[level.to], level.weight, 0.0), n).tolist()
    cut = list(inside)  # weight from a part to the rest of its group
    order = list(range(n))
    rng.shuffle(order)
    for v in order:
        m = level.mass[v]
        if not alone[v] or inside[v] < level.penalty * m * (total[group[v]] - m):
            continue
        toward: dict[int, float] = {}
        for u, w in level.links(v):
            if group[u] == group[v]:
                toward[part[u]] = toward.get(part[u], 0.0) + w
        best, gain = part[v], 0.0
        for p in sorted(toward):
            fit = cut[p] >= level.penalty * mass[p] * (total[group[v]] - mass[p]) - 1e-12
            if p != part[v] and fit and (d := toward[p] - level.penalty * m * mass[p]) > gain:
                best, gain = p, d
        if best != part[v]:
            cut[best] += inside[v] - 2 * toward[best]
            mass[best] += m
            mass[part[v]] = cut[part[v]] = 0.0
            part[v], alone[best], alone[v] = best, False, False
    return part


def leiden(nodes: Sequence[int], edges, *, resolution: float = 1.0, seed: int = 0, objective: str = "modularity", n_iterations: int = 5) -> dict[int, int]:
    """Community of every node, for edges (a, b, w) as rows or as three arrays. All are sorted first, so that the result depends on the graph and the seed alone."""
    names, rng = np.unique(np.asarray(nodes, np.int64)), random.Random(seed)
    a, b, w = edges if isinstance(edges, tuple) else (zip(*edges) if len(edges) else ([], [], []))
    a, b = (np.searchsorted(names, np.asarray(x, np.int64)) for x in (a, b))
    row, to, w = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.asarray(w, float), 2)
    order = np.lexsort((w, to, row))
    row, to, w = row[order], to[order], w[order]
    once = np.r_[(row[1:] != row[:-1]) | (to[1:] != to[:-1]), np.ones(min(1, len(row)), bool)] & (row != to)
    row, to, w = row[once], to[once], w[once]
    n = len(names)
    strength = np.bincount(row, w, n)
    base = _Level(row, to, w, strength, np.ones(n), objective, resolution, float(strength.sum()))
    member = list(range(n))
    for _ in range(n_iterations):
        start, level, of = list(member), base, np.arange(n)
        group = list(member)
        while True:
            moved = _move(level, group, rng)
            member = np.array(group, np.int64)[of].tolist()
            part = np.array(_refine(level, group, rng), np.int64)
            kept, part = np.unique(part, return_inverse=True)
            if len(kept) == len(part) or not moved and len(kept) == len(set(group)):
                break
            upper = np.zeros(len(kept), np.int64)
            upper[part] = group
            of, level = part[of], level.merged(part, len(kept))
            group = np.unique(upper, return_inverse=True)[1].tolist()
        first: dict[int, int] = {}
        member = [first.setdefault(g, len(first)) for g in member]
        if member == start:
            break
    return dict(zip(names.tolist(), member))


def detect(edges: DataFrame, nodes: DataFrame, *, resolution: float = 1.0, seed: int = 0, objective: str = "modularity", n_iterations: int = 5) -> DataFrame:
    """(run_id, event_id, raw) for edges (run_id, src, dst, w) and nodes (run_id, event_id), each run in a task of its own.

    ``nodes`` may carry resolution and seed columns of its own. A run must fit one task: the method is sequential.
    """
    if objective not in ("modularity", "cpm"):
        raise ConfigurationError(f"objective {objective!r}")
    if not resolution > 0:
        raise ConfigurationError("resolution must be positive")
    if "resolution" not in nodes.columns:
        nodes = nodes.withColumn("resolution", F.lit(float(resolution)))
    if "seed" not in nodes.columns:
        nodes = nodes.withColumn("seed", F.lit(seed))

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"run_id": [], "event_id": [], "raw": []})
        got = leiden(n.event_id.to_numpy(), (e.src.to_numpy(), e.dst.to_numpy(), e.w.to_numpy()), resolution=float(n.resolution.iloc[0]), seed=int(n.seed.iloc[0]), objective=objective, n_iterations=n_iterations)
        return pd.DataFrame({"run_id": key[0], "event_id": list(got), "raw": list(got.values())})

    # new column identities, as both may come of one table of runs
    left, right = (d.select(*(F.col(c).alias(c) for c in d.columns)).groupBy("run_id") for d in (nodes, edges))
    return left.cogroup(right).applyInPandas(run, "run_id long, event_id long, raw int")


def detect_lists(lists: DataFrame, runs: DataFrame, *, weighting: str, prune_below: float, objective: str = "modularity", n_iterations: int = 5) -> DataFrame:
    """(run_id, event_id, raw) for neighbour lists (run_id, event_id, js, ds), each run in a task of its own, where its graph is made too.

    ``runs`` has a row a run: (run_id, k, resolution, seed). Numbers are dealt to the runs so that their hashes put no two into a task.
    """
    if objective not in ("modularity", "cpm"):
        raise ConfigurationError(f"objective {objective!r}")
    jobs = runs.select("run_id", "k", "resolution", "seed").orderBy(F.desc("k"), "run_id").collect()
    n, free = len(jobs), {}
    for r in runs.sparkSession.range(30 * n + 300).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("task")).orderBy("id").collect():  # a few numbers a run
        free.setdefault(r.task, r.id)
    spare = iter(range(1 << 40, (1 << 40) + n))
    dealt = [(j.run_id, free.get(t) if t in free else next(spare)) for t, j in enumerate(jobs)]
    of = {task: jobs[t] for t, (_, task) in enumerate(dealt)}
    keys = F.broadcast(runs.sparkSession.createDataFrame(dealt, "run_id long, task long"))

    def run(key, table):
        job, own = of[key[0].as_py()], table.column("event_id").to_numpy()
        js, ds = (table.column(c).combine_chunks() for c in ("js", "ds"))
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(own)), js.value_lengths().to_numpy())
        e = edges_of_lists(own, rows, flat(js), flat(ds), job.k, weighting, prune_below)
        got = leiden(own, e, resolution=job.resolution, seed=job.seed, objective=objective, n_iterations=n_iterations)
        return pa.table({"run_id": pa.array([job.run_id] * len(got), pa.int64()), "event_id": pa.array(list(got), pa.int64()), "raw": pa.array(list(got.values()), pa.int32())})

    return lists.join(keys, "run_id").select("task", "event_id", "js", "ds").repartition(n, "task").groupBy("task").applyInArrow(run, "run_id long, event_id long, raw int")


def quality(edges: DataFrame, labels: DataFrame, *, resolution: float = 1.0, objective: str = "modularity") -> DataFrame:
    """One row: quality of raw labels (event_id, community), not normalised."""
    if objective not in ("modularity", "cpm"):
        raise ConfigurationError(f"objective {objective!r}")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("event_id"), "w").groupBy("event_id").agg(F.sum("w").alias("k"))
    mass = labels.join(ends, "event_id", "left").groupBy("community").agg(F.sum(F.coalesce("k", F.lit(0.0))).alias("k"), F.count("*").alias("n"))
    named = lambda end: labels.select(F.col("event_id").alias(end), F.col("community").alias(f"c_{end}"))
    inner = edges.join(named("src"), "src").join(named("dst"), "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.sum("w").alias("inside"))
    rows = mass.join(inner, "community", "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    if objective == "cpm":
        return rows.agg(F.sum(2 * F.col("inside") - resolution * F.col("n") * (F.col("n") - 1)).alias("quality"))
    sums = rows.agg(F.sum("inside").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum("k").alias("m2"))
    return sums.select((2 * F.col("i") - F.when(F.col("m2") > 0, resolution * F.col("kk") / F.col("m2")).otherwise(0.0)).alias("quality"))


def relabel(raw: DataFrame, min_size: int = 10) -> DataFrame:
    """(event_id, community) of (event_id, raw): by size, then by first member; small ones are -1. With a run_id column, run by run."""
    if min_size < 1:
        raise ConfigurationError("min_size must be at least 1")
    by = ["run_id"] if "run_id" in raw.columns else []
    groups = raw.groupBy(*by, "raw").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "first")  # over one row a community
    names = groups.select(*by, "raw", F.when(F.col("n") < min_size, UNASSIGNED).otherwise(F.row_number().over(order) - 1).alias("community"))
    return raw.join(names, [*by, "raw"]).select(*by, "event_id", F.col("community").cast("int").alias("community"))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("community").agg(F.count("*").alias("n"))


def members(labels: DataFrame, community: int) -> DataFrame:
    rows = labels.where(F.col("community") == community).select("event_id")
    if rows.isEmpty():
        raise CommunityNotFound(f"no community {community}")
    return rows
