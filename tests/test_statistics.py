"""Neighbours, order statistics, tests and agreement against plain numpy."""

import math
import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom import errors as err
from eventloom.operators import agreement, compare, graph, ranks
from eventloom.plans import catalogue


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "event_id long, v array<double>")


def plain_near(matrix, k, metric, p=2.0):
    measure = {
        "euclidean": lambda a, b: math.dist(a, b), "sqeuclidean": lambda a, b: math.dist(a, b) ** 2, "manhattan": lambda a, b: sum(map(abs, a - b)), "chebyshev": lambda a, b: max(map(abs, a - b)),
        "cosine": lambda a, b: 1 - (a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.any() and b.any() else 0), "minkowski": lambda a, b: sum(abs(a - b) ** p) ** (1 / p),
        "canberra": lambda a, b: sum(abs(x - y) / (abs(x) + abs(y)) for x, y in zip(a, b) if x or y), "hamming": lambda a, b: float(np.mean(a != b)),
        "braycurtis": lambda a, b: sum(abs(a - b)) / s if (s := sum(abs(a + b))) else sum(abs(a - b)), "correlation": lambda a, b: 1 - np.corrcoef(a, b)[0, 1],
    }[metric]
    out = {}
    for i, a in enumerate(matrix):
        d = sorted((round(measure(a, b), 9), j) for j, b in enumerate(matrix) if j != i)[:k]
        out[i] = [x for x, _ in d]
    return out


@pytest.mark.parametrize(("metric", "p"), [("euclidean", 2), ("sqeuclidean", 2), ("manhattan", 2), ("chebyshev", 2), ("cosine", 2), ("minkowski", 2), ("minkowski", 3), ("canberra", 2), ("hamming", 2), ("braycurtis", 2), ("correlation", 2)])
def test_neighbours_by_every_metric(spark, metric, p):
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 4, (40, 5)).astype(float) + (rng.normal(size=(40, 5)) if metric == "correlation" else 0)  # many ties
    if metric != "correlation":
        matrix[3] = 0  # a zero vector has neighbours by every metric
    v = frame(spark, matrix)
    got = graph.nearest(v, v, 6, metric, same=True, p=p).orderBy("i", "rank").collect()
    want = plain_near(matrix, 6, metric, p)
    assert {i: [r.d for r in got if r.i == i] for i in want} == {i: pytest.approx(d, abs=1e-8) for i, d in want.items()}
    for a, b in zip(got, got[1:]):
        assert a.i != b.i or (a.rank + 1 == b.rank and (a.d, a.j) < (b.d, b.j))


def test_blocks_find_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    matrix = np.concatenate([rng.integers(0, 3, (60, 3)), rng.integers(0, 3, (60, 3)) + 0.5, np.ones((30, 3))]).astype(float)
    v = frame(spark, matrix)
    for metric in ("euclidean", "cosine", "manhattan"):
        rows = lambda: sorted(map(tuple, graph.nearest(v, v, 7, metric, same=True).select("i", "j", "d", "rank").collect()))
        one = rows()
        with monkeypatch.context() as m:
            m.setattr(graph, "BROADCAST_BYTES", 0)
            m.setattr(graph, "BLOCK_BYTES", 40 * 3 * 8)
            m.setattr(graph, "NUMBERS", 50)
            assert rows() == one and len(one) == 150 * 7


def test_temporaries_are_bounded(monkeypatch):
    seen = []
    real = np.abs
    monkeypatch.setattr(graph, "NUMBERS", 1000)
    measure = lambda a, b: (seen.append((a - b).size), real(a - b).sum(-1))[1]
    rng = np.random.default_rng(0)
    graph._whole(measure, rng.normal(size=(10, 7)), rng.normal(size=(300, 7)))
    assert max(seen) <= 1000


def measured(monkeypatch, metric, rows=64):
    """What share of the pairs is measured by the definition; the neighbours are checked against a plain search."""
    seen, real = [], graph.METRICS[metric]
    matrix = np.random.default_rng(9).normal(size=(9000, 24))
    ids = np.arange(9000)
    with monkeypatch.context() as m:
        m.setitem(graph.METRICS, metric, lambda a, b: (seen.append(np.broadcast(a, b).size), real(a, b))[1])
        got = graph._search(ids[:rows], matrix[:rows], ids, matrix, 5, metric, 2.0, True)
    for i in range(0, rows, 16):
        d = real(matrix[i], matrix)
        d[i] = np.inf
        assert got.column(1).to_pylist()[5 * i : 5 * i + 5] == np.argsort(d, kind="stable")[:5].tolist()
    return sum(seen) / (rows * matrix.size)


def test_few_chebyshev_distances_are_measured(monkeypatch):
    assert measured(monkeypatch, "chebyshev") < 0.1


def test_few_manhattan_distances_are_measured(monkeypatch):
    assert measured(monkeypatch, "manhattan") < 0.1


@pytest.mark.parametrize("draw", ["normal", "standard_cauchy", "uniform"])
def test_manhattan_neighbours_with_any_tails(draw):
    rng = np.random.default_rng(11)
    matrix = getattr(rng, draw)(size=(6000, 16))
    matrix[50:60], matrix[60] = matrix[40:50], np.nan
    queries = np.concatenate([matrix[:60], rng.normal(size=(3, 16)) * 1e50])  # the last far from all of the base
    got = graph._search(np.arange(63) + 10_000, queries, np.arange(6000), matrix, 5, "manhattan", 2.0, True)
    real = graph.METRICS["manhattan"]
    assert got.column(1).to_pylist() == [j for q in queries for j in np.argsort(real(q, matrix), kind="stable")[:5].tolist()]  # no number comes last


def test_few_manhattan_distances_are_measured_beside_a_wide_column():
    rng = np.random.default_rng(12)
    matrix = rng.normal(size=(6000, 16))
    matrix[:, 0] = rng.integers(0, 2, 6000) * 1e4  # as scatter beside markers
    seen, real, ids = [], graph.METRICS["manhattan"], np.arange(6000)
    base = graph._Base(ids, matrix, "manhattan", 2.0)
    base.measure = lambda a, b: (seen.append(np.broadcast(a, b).size), real(a, b))[1]
    got = base.search(ids[:64], matrix[:64], 5, False)
    assert got.column(1).to_pylist() == [j for q in matrix[:64] for j in np.argsort(real(q, matrix), kind="stable")[:5].tolist()]
    assert sum(seen) < 0.1 * 64 * matrix.size


def test_a_worker_makes_the_bounds_of_a_broadcast_base_once(monkeypatch):
    made, real = [], graph._bounds
    monkeypatch.setattr(graph, "_bounds", lambda *x: (made.append(1), real(*x))[1])
    sent = pickle.loads(pickle.dumps(graph._Sent(np.arange(9), np.eye(9), "manhattan", 2.0)))
    assert sent.base().search(np.arange(2), np.eye(9)[:2], 2, True).column(1).to_pylist() == [1, 2, 0, 2] and sent.base() is sent.base() and len(made) == 1


def test_lists_by_two_metrics_measure_few_distances(monkeypatch):
    assert sum(measured(monkeypatch, metric, 16) for metric in ("euclidean", "manhattan")) < 0.2


def test_lists_by_two_metrics_come_from_one_search(spark, monkeypatch):
    made, real = [], graph._near_broadcast
    monkeypatch.setattr(graph, "_near_broadcast", lambda *x: (made.append(1), real(*x))[1])
    assert catalogue.QUERIES["neighbour_jaccard"](spark, "/root/testdata/sf0.001").count() == 500 and len(made) == 1


@pytest.mark.parametrize("blocks", [False, True])
def test_one_search_by_each_metric_finds_what_each_finds_alone(spark, monkeypatch, blocks):
    rng = np.random.default_rng(4)
    matrix = np.concatenate([rng.integers(0, 3, (60, 3)), rng.normal(size=(60, 3)), np.ones((30, 3))]).astype(float)  # many ties and copies
    v, metrics = frame(spark, matrix), ["euclidean", "manhattan", "chebyshev", "cosine"]
    if blocks:
        monkeypatch.setattr(graph, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(graph, "BLOCK_BYTES", 40 * 3 * 8)
    rows = lambda near: sorted(map(tuple, near.select("i", "j", "d", "rank").collect()))
    each = graph.nearest_by_each(v, v, 7, metrics, same=True).cache()
    for at, metric in enumerate(metrics):
        assert rows(each.where(F.col("metric") == at)) == rows(graph.nearest(v, v, 7, metric, same=True))
    assert each.count() == 4 * 150 * 7


def test_neighbours_by_one_metric_limit_those_by_the_next(monkeypatch):
    matrix, ids, left, real = np.random.default_rng(9).normal(size=(9000, 24)), np.arange(9000), [], graph._places
    monkeypatch.setattr(graph, "_places", lambda mask: (left.append(mask.sum()), real(mask))[1])
    bases = [graph._Base(ids, matrix, metric, 2.0) for metric in ("euclidean", "manhattan")]
    alone = [base.search(ids[:64], matrix[:64], 5, True) for base in bases]
    n, left[:] = sum(left), []
    both = graph._search_each(bases, ids[:64], matrix[:64], 5, True)
    assert [both.filter(pa.array(both.column(0).to_numpy() == at)).select(["i", "j", "d"]) for at in (0, 1)] == alone
    assert sum(left) < 0.8 * n


def test_neighbours_by_run(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(50, 3))
    runs = {0: range(0, 50, 2), 1: range(0, 50, 3), 2: range(50)}
    rows = spark.createDataFrame([(r, i, matrix[i].tolist()) for r, ids in runs.items() for i in ids], "run_id long, event_id long, v array<double>")
    got = graph.nearest_by_run(rows, 4).collect()
    for r, ids in runs.items():
        v = rows.where(F.col("run_id") == r).select("event_id", "v")
        assert sorted((x.i, x.j, x.rank) for x in got if x.run_id == r) == sorted((x.i, x.j, x.rank) for x in graph.nearest(v, v, 4, same=True).collect())
    edges = graph.weigh(graph.nearest_by_run(rows, 4), 4)
    v = rows.where("run_id = 1").drop("run_id")
    assert sorted(map(tuple, edges.where("run_id = 1").drop("run_id").collect())) == sorted(map(tuple, graph.weigh(graph.nearest(v, v, 4, same=True), 4).collect()))


@pytest.mark.parametrize("weighting", ["jaccard", "distance", "uniform"])
def test_lists_of_runs_are_those_of_searches(spark, weighting):
    """From more neighbours of all, and where these are too few; weights are those of ``weigh``."""
    v = frame(spark, np.random.default_rng(10).normal(size=(60, 3)))
    drawn = spark.createDataFrame([(r, i) for r in range(70) for i in range(60) if (i * 7 + r * 11) % 5], "run_id long, event_id long")
    want = graph.nearest_by_run(drawn.join(v, "event_id").select("run_id", "event_id", "v"), 4)
    lists = {}
    for most in (12, 5):
        got = graph.lists_of_runs(graph.nearest(v, v, most, same=True), drawn.where("run_id in (0, 61, 62, 69)"), v, 70, 4).collect()
        lists[most] = {(r.run_id, r.event_id): (r.js, r.ds) for r in got}
    by = {}
    for r in want.where("run_id in (0, 61, 62, 69)").orderBy("rank").collect():
        by.setdefault((r.run_id, r.i), ([], []))
        by[r.run_id, r.i][0].append(r.j)
        by[r.run_id, r.i][1].append(r.d)
    assert lists[12] == lists[5] == by
    mine = {i: x for (r, i), x in by.items() if r == 62}
    of = [(x, j, d) for x, (js, ds) in enumerate(mine.values()) for j, d in zip(js, ds)]
    src, dst, w = graph.edges_of_lists(np.array(list(mine)), *map(np.array, zip(*of)), 4, weighting, 1 / 15)
    edges = graph.weigh(want.where("run_id = 62").drop("run_id"), 4, weighting).collect()
    assert {(a, b): x for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist())} == {(r.src, r.dst): pytest.approx(r.w, abs=1e-12) for r in edges}


def test_a_base_is_cut_into_few_blocks(spark, monkeypatch):
    """Queries meet few rows for each block of a base, so its blocks are larger than theirs."""
    monkeypatch.setattr(graph, "BLOCK_BYTES", 10 * 3 * 8)
    v = frame(spark, np.random.default_rng(11).normal(size=(160, 3)))
    groups = graph.cells(v, v, 160, 160, 3, lambda own, rows, ids, matrix: graph.pa.RecordBatch.from_arrays([graph.pa.array([len(ids)])], names=["n"]), "n long").collect()
    assert len(groups) == 32 and sum(g.n for g in groups) == 16 * 160


def test_unknown_metrics(spark):
    v = frame(spark, np.eye(3))
    with pytest.raises(err.ConfigurationError, match="canberra"):
        graph.nearest(v, v, 1, "manhatan")
    with pytest.raises(err.ConfigurationError, match="p="):
        graph.nearest(v, v, 1, "minkowski", p=0.5)


def test_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(4)
    values = {"x": rng.integers(0, 40, 300) / 8, "y": rng.normal(size=77), "z": np.array([2.5])}
    rows = spark.createDataFrame([(m, float(v)) for m, vs in values.items() for v in vs], "marker string, value double")
    counts = rows.groupBy("marker", "value").agg(F.count("*").alias("n"))
    for r in ranks.running(counts, ["marker"], "value", ["n"]).collect():
        assert r.below_n == (values[r.marker] < r.value).sum() and r.n == (values[r.marker] == r.value).sum()
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in ranks.quantiles(rows, ["marker"], "value", probs).collect():
        assert [r[f"q_{i}"] for i in range(len(probs))] == pytest.approx(np.quantile(values[r.marker], probs))


def sides(spark, a, b):
    return spark.createDataFrame([("m", s, float(v)) for s, vs in (("a", a), ("b", b)) for v in vs], "marker string, side string, value double")


def plain_delta(a, b):
    return float(np.mean(np.sign(np.subtract.outer(a, b))))


@pytest.mark.parametrize("size", [1, 7, 1 << 15])
def test_resamples_by_ranges(spark, monkeypatch, size):
    """Deltas of resamples have the spread of plain ones, however the values are cut into ranges."""
    monkeypatch.setattr(compare, "RANGE", size)
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0.4, 1, 60), 1), np.round(rng.normal(0, 1, 50), 1)
    rows = sides(spark, a, b)
    ci = compare.bootstrap_ci(rows, 400, seed=3).first()
    plain = [plain_delta(rng.choice(a, 60), rng.choice(b, 50)) for _ in range(400)]
    assert (ci.ci_low, ci.ci_high) == pytest.approx(tuple(np.percentile(plain, (2.5, 97.5))), abs=0.08)
    seen, pool = plain_delta(a, b), np.concatenate([a, b])
    turns = [plain_delta(x[:60], x[60:]) for x in (rng.permutation(pool) for _ in range(400))]
    want = (sum(abs(t) >= abs(seen) - 1e-12 for t in turns) + 1) / 401
    assert compare.permutation_p(rows, 400, seed=3).first().p == pytest.approx(want, abs=0.06)


def test_resamples_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    rows = sides(spark, rng.normal(size=40), rng.normal(size=30))
    one = compare.bootstrap_ci(rows, 60).first(), compare.permutation_p(rows, 60).first()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = rows.repartition(5)
        assert (compare.bootstrap_ci(again, 60).first(), compare.permutation_p(again, 60).first()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_extreme_samples(spark):
    assert compare.cliffs_delta(sides(spark, [4, 5, 6], [1, 2, 3])).first().delta == 1 and compare.cliffs_delta(sides(spark, [2, 2], [2])).first().delta == 0
    assert compare.permutation_p(sides(spark, range(30, 60), range(30)), 99).first().p == 0.01
    assert compare.permutation_p(sides(spark, [1, 2], [1, 2]), 99).first().p == 1
    assert compare.bootstrap_ci(sides(spark, [1], []), 9).collect() == []
    ci = compare.bootstrap_ci(sides(spark, [4, 5, 6], [1, 2, 3]), 50).first()
    assert (ci.ci_low, ci.ci_high) == (1, 1)


def test_energy_distance_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    a, b = rng.normal(0, 1, (50, 2)), rng.normal(1, 1, (40, 2))
    mean = lambda x, y: np.mean([math.dist(p, q) for p in x for q in y])
    inner = lambda x: np.mean([math.dist(p, q) for p, q in combinations(x, 2)])
    want = 2 * mean(a, b) - inner(a) - inner(b)
    for size in (graph.BLOCK_BYTES, 15 * 16):
        monkeypatch.setattr(graph, "BLOCK_BYTES", size)
        assert compare.energy_distance(frame(spark, a), frame(spark, b)).first().energy == pytest.approx(want)
    assert compare.energy_distance(frame(spark, a), frame(spark, a)).first().energy < 0.2
    assert compare.energy_distance(frame(spark, a[:1]), frame(spark, a[:1])).first().energy == 0


def plain_ami(u, v):
    """Expected information by enumeration of all shared counts, with exact binomials."""
    n, cells = len(u), {}
    for x, y in zip(u, v):
        cells[x, y] = cells.get((x, y), 0) + 1
    a, b = {x: u.count(x) for x in u}, {y: v.count(y) for y in v}
    entropy = lambda s: -sum(c / n * math.log(c / n) for c in s.values())
    mi = sum(c / n * math.log(n * c / (a[x] * b[y])) for (x, y), c in cells.items())
    e = sum(c / n * math.log(n * c / (p * q)) * math.comb(p, c) * math.comb(n - p, q - c) / math.comb(n, q) for p in a.values() for q in b.values() for c in range(max(1, p + q - n), min(p, q) + 1))
    return (mi - e) / ((entropy(a) + entropy(b)) / 2 - e)


def test_adjusted_mutual_information(spark):
    rng = np.random.default_rng(8)
    for n in (12, 90, 400):
        u = rng.integers(0, 4, n).tolist()
        v = [x if rng.random() < 0.6 else int(rng.integers(0, 5)) for x in u]
        as_frame = lambda s: spark.createDataFrame(list(enumerate(s)), "event_id long, label int")
        got = agreement.adjusted_mutual_info(agreement.contingency(as_frame(u), as_frame(v))).first().ami
        assert got == pytest.approx(plain_ami(u, v), abs=1e-9)
    assert agreement._log_gamma(np.array([1.0, 2, 3.5, 50, 1e6])) == pytest.approx([math.lgamma(x) for x in (1, 2, 3.5, 50, 1e6)], abs=1e-9)


def test_jaccard_of_sets(spark):
    rows = spark.createDataFrame([([], []), ([1, 2], [1, 2]), ([1, 2], [3]), ([1, 2], [2, 3]), ([1, 1], [1])], "a array<int>, b array<int>")
    assert [r.j for r in rows.select(agreement.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == pytest.approx([1, 1, 0, 1 / 3, 1])


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 1.0]
    got = {r.marker: r.q for r in compare.benjamini_hochberg(spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "marker string, p double")).collect()}
    assert [got[str(i)] for i in range(5)] == pytest.approx([0.025, 0.05, 0.05, 0.025, 1.0])
