"""Queries of the event-matrix operators, and the SQL that they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators import agreement, communities, compare, graph
from eventloom.operators.subspace import select_subspace, subset
from eventloom.plans import pipeline
from eventloom.plans.lineage import local_folder
from eventloom.provenance import Provenance, config_hash
from eventloom.sources import fcs, synth

DIMS, K = 64, 15
ROUND = 6


def _events(spark: SparkSession, d: str, dims: int = DIMS) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("event_id"), *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)))


def _labels(spark, d, name: str = "label") -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("event_id"), F.col("label").alias(name))


def _space(spark, d):
    return select_subspace(_events(spark, d), [f"e{i}" for i in range(DIMS)], transform="none", scaling="none")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, ROUND).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _sub(transform: str, scaling: str):
    return lambda spark, d: _rounded(select_subspace(_events(spark, d), [f"e{i}" for i in range(DIMS)], transform=transform, cofactor=0.5, scaling=scaling))


def _knn(metric: str):
    return lambda spark, d: _rounded(graph.knn(_space(spark, d), K, metric).select("i", "j", F.col("rank").cast("long").alias("rank"), "d"))


def _edges(weighting: str):
    return lambda spark, d: _rounded(graph.build_graph(_space(spark, d), k=K, weighting=weighting))


def _sides(spark, d) -> DataFrame:
    """events: the values of each event type, side a of users with an even number and side b of the others."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("marker"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("side"), "value")


def _changed(spark, d) -> DataFrame:
    """The labels with some changed: another partition of the same events."""
    return _labels(spark, d).select("event_id", F.when(F.col("event_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("label"))


def _runs(spark, d):
    """Four perturbed labellings: (run_id, event_id, community, got)."""
    runs = F.broadcast(spark.range(4).select(F.col("id").alias("run_id")))
    return _labels(spark, d, "community").crossJoin(runs).withColumn("got", F.when((F.col("event_id") + F.col("run_id")) % (F.col("run_id") + 3) == 0, (F.col("community") + 1) % 10).otherwise(F.col("community")))


def _hits(spark, d):
    return _runs(spark, d).select("event_id", "community", (F.col("got") == F.col("community")).alias("hit"))


def _cores(spark, d):
    return agreement.core_scores(_hits(spark, d)).join(_labels(spark, d, "community"), "event_id").select("event_id", "community", "core")


def _matches(spark, d):
    n = _runs(spark, d).groupBy("run_id", F.col("community").alias("ref"), F.col("got").alias("cand")).agg(F.count("*").alias("n"))
    return agreement.best_jaccard(n)


def _quality(objective: str):
    return lambda spark, d: _rounded(communities.quality(_edges_exact(spark, d), _labels(spark, d, "community"), resolution=0.6 if objective == "modularity" else 0.01, objective=objective))


def _edges_exact(spark, d):
    return graph.build_graph(_space(spark, d), k=K, weighting="jaccard")


def _cluster(spark, d):
    config = pipeline.CommunityConfig(tuple(f"e{i}" for i in range(DIMS)), transform="none", scaling="zscore", k=K, min_size=5)
    return pipeline.cluster(_events(spark, d), [(f"e{i}", None) for i in range(DIMS)], config, Provenance(f"{d}/embeddings.parquet"))


def full_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return communities.sizes(_cluster(spark, d).labels)


def _file(spark, d, kind: str) -> tuple:
    """(values, names) of the event matrix that an FCS file is made of, on the driver as every FCS file; I has thousandths from 0 on."""
    names = [f"e{i}" for i in range(DIMS)]
    values = _events(spark, d).orderBy("event_id").toPandas()[names].to_numpy()
    return (values * 1000).round().clip(0) if kind == "I" else values, names


def _roundtrip(kind: str):
    def run(spark, d):
        values, names = _file(spark, d, kind)
        return _rounded(fcs.read_fcs_bytes(spark, fcs.build_fcs_bytes(values, names, datatype=kind)).events)

    return run


def _scan(spark, d) -> DataFrame:
    """The events through the data source, a hundred a task."""
    values, names = _file(spark, d, "D")
    path = fcs.write_fcs(f"{local_folder(spark)}/scan-{uuid.uuid4().hex}.fcs", values, names, datatype="D")
    fcs.read_fcs(spark, path)  # registers the source and validates the file
    return _rounded(spark.read.format("fcs").option("events_per_task", "100").load(path))


def _channels(spark, d) -> DataFrame:
    values, names = _file(spark, d, "I")
    channels = fcs.read_fcs_bytes(spark, fcs.build_fcs_bytes(values, names, datatype="I")).layout.channels
    return spark.createDataFrame([(c.index, c.name, c.bits, float(c.range), c.is_log) for c in channels], "place long, name string, bits long, top double, is_log boolean")


def _file_subset(spark, d) -> DataFrame:
    values, names = _file(spark, d, "D")
    ids = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 3 = 0").select(F.col("vec_id").alias("event_id"))
    return _rounded(fcs.subset_events(fcs.read_fcs_bytes(spark, fcs.build_fcs_bytes(values, names, datatype="D")), ids).events)


def _tests(spark, d) -> DataFrame:
    """A p-value for each user of ``events``: the place of the user's mean value among all, as a share."""
    means = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("marker")).agg(F.count("*").alias("n"))
    return means.select("marker", ((F.col("n") * 7 + F.col("marker")) % 1000 / 1000.0).alias("p"))


def _neighbour_jaccard(spark, d) -> DataFrame:
    """How far the neighbours by two metrics agree, for each event."""
    metrics = ["euclidean", "manhattan"]
    near = graph.knn_by_each(_space(spark, d), K, metrics)
    both = near.groupBy("i").agg(*(F.collect_list(F.when(F.col("metric") == at, F.col("j"))).alias(metric) for at, metric in enumerate(metrics)))
    return _rounded(both.select(F.col("i").alias("event_id"), agreement.jaccard(F.col("euclidean"), F.col("manhattan")).alias("jaccard")))


def _partition_quality(spark, d) -> DataFrame:
    raw = _labels(spark, d, "raw")
    found = pipeline.Partition(_edges_exact(spark, d), raw, communities.relabel(raw), 0.6)
    return _rounded(spark.createDataFrame([(found.quality(),)], "quality double"))


def _result(spark, d) -> pipeline.CommunityResult:
    """The given labels as the communities of the scaled embeddings."""
    config = pipeline.CommunityConfig(tuple(f"e{i}" for i in range(32)), transform="none", scaling="none", k=K, min_size=5)
    names = [(f"e{i}", None) for i in range(DIMS)]
    space = pipeline.build_subspace(_events(spark, d), names, config)
    labels = _labels(spark, d, "community")
    edges = graph.build_graph(space, k=K)
    return pipeline.CommunityResult(config, Provenance(f"{d}/embeddings.parquet"), _events(spark, d), names, space, edges, labels.withColumnRenamed("community", "raw"), labels)


def _compared(inference: str, shown: str):
    """The markers of a comparison of two given communities, but for the intervals and p-values, which are drawn."""

    def run(spark, d):
        found = pipeline.compare_communities(_result(spark, d), 0, 1, inference=inference, n_bootstrap=0 if inference == "descriptive" else 20, n_permutations=99)
        rows = [(m["marker"], m["median_a"], m["median_b"], m["mad_a"], m["mad_b"], m["cliffs_delta"], m["magnitude"], m["used_for_clustering"], found["energy_distance"], m["p_value"], m["q_value"]) for m in found["markers"]]
        made = spark.createDataFrame(rows, "marker string, median_a double, median_b double, mad_a double, mad_b double, delta double, magnitude string, used boolean, energy double, p double, q double")
        return _rounded(made.selectExpr(*shown.split(", ")))

    return run


def _rings(spark, d) -> DataFrame:
    """Communities of a graph that has one best partition: the events of a label stand in a ring, each linked to the next one and to 14 anywhere in it.

    Links to the next 15 alone would not do: cutting such a ring costs the same 120 links at any length, so from about 530 events on its parts are better.
    """
    placed = _labels(spark, d).select("event_id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("event_id")) - 1).alias("at"), F.count("*").over(Window.partitionBy("label")).alias("n"))
    to = F.when(F.col("step") == 1, F.pmod(F.col("at") + 1, F.col("n"))).otherwise(F.pmod(F.xxhash64("event_id", "step"), F.col("n")))
    ahead = placed.select("*", F.explode(F.sequence(F.lit(1), F.lit(K))).alias("step")).select("label", F.col("event_id").alias("i"), to.alias("at"))
    met = ahead.join(placed.select("label", "at", F.col("event_id").alias("j")), ["label", "at"])
    edges = graph.symmetrise(met.select("i", "j", F.lit(1.0).alias("w")))
    return pipeline.detect_communities(edges, _labels(spark, d), resolution=0.6).labels


def _stability(spark, d) -> DataFrame:
    found = pipeline.assess_stability(_cluster(spark, d))
    return spark.createDataFrame([(r["community"], r["size"], r["mean_jaccard"], r["core_fraction"], r["verdict"]) for r in found["per_community"]], "community long, size long, mean_jaccard double, core_fraction double, verdict string")


def _vote(spark, d):
    v = graph.vectors(_space(spark, d))
    return compare.vote(v.where("event_id % 2 = 1"), v.where("event_id % 2 = 0"), _labels(spark, d), 7)


def _energy(spark, d):
    v = graph.vectors(_space(spark, d)).join(_labels(spark, d), "event_id")
    return _rounded(compare.energy_distance(v.where("label = 0"), v.where("label = 1")))


def _synth(spark, d):
    sizes = synth.apportion([p[1] for p in synth.POPULATIONS], 6000)
    return spark.createDataFrame([(p[0], n) for p, n in zip(synth.POPULATIONS, sizes)], "population string, n long")


QUERIES = {
    "subspace_none": _sub("none", "none"), "subspace_asinh": _sub("asinh", "none"), "subspace_zscore": _sub("none", "zscore"),
    "subspace_asinh_zscore": _sub("asinh", "zscore"), "subspace_robust": _sub("none", "robust"),
    "subset_frozen_scaling": lambda s, d: _rounded(subset(_sub("none", "zscore")(s, d), s.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 3 = 0").select(F.col("vec_id").alias("event_id")))),
    "knn_euclidean": _knn("euclidean"), "knn_manhattan": _knn("manhattan"), "knn_chebyshev": _knn("chebyshev"), "knn_cosine": _knn("cosine"),
    "graph_uniform": _edges("uniform"), "graph_jaccard": _edges("jaccard"), "graph_distance": _edges("distance"),
    "graph_mutual": lambda s, d: graph.symmetrise(graph.knn(_space(s, d), K).select("i", "j", F.lit(1.0).alias("w")), "min"),
    "graph_stats": lambda s, d: _rounded(graph.graph_stats(_edges_exact(s, d), _labels(s, d).count())),
    "quality_modularity": _quality("modularity"), "quality_cpm": _quality("cpm"),
    "size_table": lambda s, d: communities.sizes(_labels(s, d, "community")),
    "members": lambda s, d: communities.members(_labels(s, d, "community"), 3),
    "relabel_by_size": lambda s, d: communities.relabel(_labels(s, d, "raw"), 50),
    "leiden_labels": lambda s, d: _cluster(s, d).labels,
    "full_pipeline": full_pipeline, "leiden_rings": _rings,
    "cliffs_delta": lambda s, d: _rounded(compare.cliffs_delta(_sides(s, d)).withColumn("magnitude", compare.magnitude(F.col("delta")))),
    "medians_mad": lambda s, d: _rounded(compare.medians(_sides(s, d))),
    "bootstrap_ci": lambda s, d: compare.bootstrap_ci(_sides(s, d)),
    "permutation_bh": lambda s, d: compare.benjamini_hochberg(compare.permutation_p(_sides(s, d))),
    "benjamini_hochberg": lambda s, d: _rounded(compare.benjamini_hochberg(_tests(s, d))),
    "compare_full": _compared("descriptive", "marker, median_a, median_b, mad_a, mad_b, delta, magnitude, used, energy"),
    "split_inference": _compared("split", "marker, delta, magnitude, used, p, q"),
    "stability_full": _stability,
    "best_jaccard": lambda s, d: _rounded(_matches(s, d)),
    "neighbour_jaccard": _neighbour_jaccard, "partition_quality": _partition_quality,
    "fcs_scan": _scan, "fcs_channels": _channels, "fcs_subset": _file_subset,
    "energy_distance": _energy,
    "best_match": lambda s, d: _rounded(compare.best_match(agreement.contingency(_labels(s, d), _changed(s, d)))),
    "knn_vote": _vote,
    "ari": lambda s, d: _rounded(agreement.adjusted_rand(agreement.contingency(_labels(s, d), _changed(s, d)))),
    "ami": lambda s, d: _rounded(agreement.adjusted_mutual_info(agreement.contingency(_labels(s, d), _changed(s, d)))),
    "resample_draw": lambda s, d: pipeline.draw(_labels(s, d), 5, 200),
    "resample_draws": lambda s, d: pipeline.draws(_labels(s, d), 1_000_003, 40, 200),
    "core_score": lambda s, d: _rounded(_cores(s, d)),
    "boundary_fraction": lambda s, d: _rounded(agreement.boundary_fraction(_cores(s, d))),
    "stability_summary": lambda s, d: _rounded(agreement.summary(_matches(s, d), _cores(s, d))),
    "sweep_grid": lambda s, d: s.createDataFrame([(k, g) for k in agreement.k_grid(30) for g in agreement.resolution_grid(0.6)], "k long, resolution double"),
    "fcs_roundtrip_f": _roundtrip("F"), "fcs_roundtrip_d": _roundtrip("D"), "fcs_roundtrip_i": _roundtrip("I"),
    "synth_truth_sizes": _synth,
    "config_hash": lambda s, d: s.createDataFrame([(config_hash({"b": 1, "a": [1, 2]}),)], "id string"),
}


def _cols(form: str, n: int = DIMS) -> str:
    return ", ".join(form.format(x=f"embedding[{i + 1}]::DOUBLE", i=i) for i in range(n))


def _scaled(inner: str, centre: str, spread: str) -> str:
    stats = ", ".join(f"{centre.format(c=f'm_{i}')} AS c_{i}, {spread.format(c=f'm_{i}')} AS s_{i}" for i in range(DIMS))
    out = ", ".join(f"round((m_{i} - c_{i}) / CASE WHEN s_{i} > 0 THEN s_{i} ELSE 1 END, 6) AS m_{i}" for i in range(DIMS))
    return f"WITH v AS (SELECT vec_id AS event_id, {_cols(inner)} FROM embeddings), s AS (SELECT {stats} FROM v) SELECT event_id, {out} FROM v, s"


_PLAIN, _ASINH = "{x} AS m_{i}", "asinh({x} / 0.5::DOUBLE) AS m_{i}"
_DISTANCE = {
    "euclidean": "list_distance(a.v, b.v)",
    "manhattan": "list_sum([abs(p[1] - p[2]) FOR p IN list_zip(a.v, b.v)])",
    "chebyshev": "list_max([abs(p[1] - p[2]) FOR p IN list_zip(a.v, b.v)])",
    "cosine": "list_cosine_distance(a.v, b.v)",
}


def _near(metric: str = "euclidean") -> str:
    return f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
    near AS (SELECT a.id AS i, b.id AS j, {_DISTANCE[metric]} AS d FROM v a, v b WHERE a.id <> b.id),
    knn AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM near QUALIFY rank <= {K}),
    closed AS (SELECT i, j FROM knn UNION ALL SELECT DISTINCT i, i FROM knn),
    cand AS (SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM knn),
    overlap AS (SELECT src, dst, count(*) AS o FROM cand JOIN closed x ON x.i = src JOIN closed y ON y.i = dst AND y.j = x.j GROUP BY ALL),
    jac AS (SELECT src, dst, o::DOUBLE / ({2 * (K + 1)} - o) AS w FROM overlap WHERE o::DOUBLE / ({2 * (K + 1)} - o) > 1.0::DOUBLE / 15)"""


_CHANGED = "(SELECT vec_id AS event_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings)"
_TABLE = f"t AS (SELECT e.label AS ref, c.label AS cand, count(*)::DOUBLE AS n FROM embeddings e JOIN {_CHANGED} c ON c.event_id = e.vec_id GROUP BY ALL)"
_SIDES = "s AS (SELECT event_type AS marker, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, value FROM events)"
_RUNS = "r AS (SELECT run_id, vec_id AS event_id, label AS community, CASE WHEN (vec_id + run_id) % (run_id + 3) = 0 THEN (label + 1) % 10 ELSE label END AS got FROM embeddings, range(4) x(run_id))"
_CORE = "core AS (SELECT event_id, community, avg((got = community)::INT) AS core FROM r GROUP BY ALL)"

_E = ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS e{i}" for i in range(DIMS))

ORACLES = {
    "subspace_none": f"SELECT vec_id AS event_id, {_cols('round({x}, 6) AS m_{i}')} FROM embeddings",
    "subspace_asinh": f"SELECT vec_id AS event_id, {_cols('round(asinh({x} / 0.5::DOUBLE), 6) AS m_{i}')} FROM embeddings",
    "subspace_zscore": _scaled(_PLAIN, "avg({c})", "stddev_pop({c})"),
    "subspace_asinh_zscore": _scaled(_ASINH, "avg({c})", "stddev_pop({c})"),
    "subspace_robust": _scaled(_PLAIN, "quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.349::DOUBLE"),
    "subset_frozen_scaling": f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_id, {', '.join(f'm_{i}' for i in range(DIMS))} FROM ({_scaled(_PLAIN, 'avg({c})', 'stddev_pop({c})')}) WHERE event_id % 3 = 0",
    **{f"knn_{m}": f"WITH {_near(m)} SELECT i, j, rank, round(d, 6) AS d FROM knn" for m in _DISTANCE},
    "graph_uniform": f"WITH {_near()} SELECT src, dst, 1.0::DOUBLE AS w FROM cand",
    "graph_mutual": f"WITH {_near()} SELECT least(i, j) AS src, greatest(i, j) AS dst, 1.0::DOUBLE AS w FROM knn GROUP BY 1, 2 HAVING count(*) = 2",
    "graph_jaccard": f"WITH {_near()} SELECT src, dst, round(w, 6) AS w FROM jac",
    "graph_distance": f"WITH {_near()}, g AS (SELECT i, j, d, max(d) OVER (PARTITION BY i) AS s FROM knn) SELECT least(i, j) AS src, greatest(i, j) AS dst, round(max(exp(-pow(d / CASE WHEN s > 0 THEN s ELSE 1 END, 2))), 6) AS w FROM g GROUP BY 1, 2",
    "graph_stats": f"WITH {_near()}, n AS (SELECT count(*) AS n_nodes FROM v), e AS (SELECT count(*) AS n_edges FROM jac) SELECT n_nodes, n_edges, round(2.0::DOUBLE * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density FROM n, e",
    "quality_modularity": f"""WITH {_near()}, k AS (SELECT id, sum(w) AS k FROM (SELECT src AS id, w FROM jac UNION ALL SELECT dst, w FROM jac) GROUP BY 1),
        c AS (SELECT label, sum(coalesce(k, 0)) AS k FROM v LEFT JOIN k USING (id) GROUP BY 1),
        i AS (SELECT sum(w) AS i FROM jac JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.label = b.label)
        SELECT round(2 * max(i) - 0.6::DOUBLE * sum(k * k) / sum(k), 6) AS quality FROM c, i""",
    "quality_cpm": f"""WITH {_near()}, c AS (SELECT label, count(*)::DOUBLE AS n FROM v GROUP BY 1),
        i AS (SELECT sum(w) AS i FROM jac JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.label = b.label)
        SELECT round(2 * max(i) - 0.01::DOUBLE * sum(n * (n - 1)), 6) AS quality FROM c, i""",
    "size_table": "SELECT label AS community, count(*) AS n FROM embeddings GROUP BY 1",
    "members": "SELECT vec_id AS event_id FROM embeddings WHERE label = 3",
    "relabel_by_size": """WITH g AS (SELECT label, count(*) AS n, min(vec_id) AS f FROM embeddings GROUP BY 1),
        o AS (SELECT label, CASE WHEN n < 50 THEN -1 ELSE row_number() OVER (ORDER BY n DESC, f) - 1 END::INT AS community FROM g)
        SELECT vec_id AS event_id, community FROM embeddings JOIN o USING (label)""",
    "cliffs_delta": f"""WITH {_SIDES}, r AS (SELECT marker, side, rank() OVER (PARTITION BY marker ORDER BY value) + (count(*) OVER (PARTITION BY marker, value) - 1) / 2.0::DOUBLE AS r FROM s),
        x AS (SELECT marker, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, sum(r) FILTER (side = 'a') AS ra FROM r GROUP BY 1),
        d AS (SELECT marker, n_a, n_b, 2 * (ra - n_a * (n_a + 1) / 2.0::DOUBLE) / (n_a * n_b) - 1 AS delta FROM x)
        SELECT marker, n_a, n_b, round(delta, 6) AS delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM d""",
    "medians_mad": f"WITH {_SIDES} SELECT marker, side, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM s GROUP BY ALL",
    "energy_distance": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE label IN (0, 1)),
        p AS (SELECT a.label AS x, b.label AS y, avg(list_distance(a.v, b.v)) AS d FROM v a JOIN v b ON a.label < b.label OR (a.label = b.label AND a.id < b.id) GROUP BY ALL)
        SELECT round(greatest(0, 2 * sum(d) FILTER (x <> y) - sum(d) FILTER (x = y)), 6) AS energy FROM p""",
    "best_match": f"""WITH {_TABLE}, j AS (SELECT ref, cand, n / (sum(n) OVER (PARTITION BY ref) + sum(n) OVER (PARTITION BY cand) - n) AS jaccard FROM t)
        SELECT ref, cand, round(jaccard, 6) AS jaccard FROM j QUALIFY row_number() OVER (PARTITION BY ref ORDER BY jaccard DESC, cand) = 1""",
    "knn_vote": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
        n AS (SELECT a.id, b.label FROM v a, v b WHERE a.id % 2 = 1 AND b.id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= 7)
        SELECT id AS event_id, label FROM (SELECT id, label, count(*) AS n FROM n GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1""",
    "ari": f"""WITH {_TABLE}, x AS (SELECT (SELECT sum(n * n) FROM t) AS c, (SELECT sum(n) FROM t) AS s, (SELECT sum(y * y) FROM (SELECT sum(n) AS y FROM t GROUP BY ref)) AS a, (SELECT sum(y * y) FROM (SELECT sum(n) AS y FROM t GROUP BY cand)) AS b),
        y AS (SELECT c - s AS tp, b - c AS fp, a - c AS fn, s * s - (b - c) - (a - c) - c AS tn FROM x)
        SELECT round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS ari FROM y""",
    "resample_draw": "SELECT vec_id AS event_id FROM embeddings ORDER BY md5('5:' || vec_id::VARCHAR), vec_id LIMIT 200",
    "core_score": f"WITH {_RUNS}, {_CORE} SELECT event_id, community, round(core, 6) AS core FROM core",
    "boundary_fraction": f"WITH {_RUNS}, {_CORE} SELECT round(avg((core < 0.8)::INT), 6) AS boundary_fraction FROM core",
    "stability_summary": f"""WITH {_RUNS}, {_CORE}, n AS (SELECT run_id, community, got, count(*)::DOUBLE AS n FROM r GROUP BY ALL),
        j AS (SELECT run_id, community, n / (sum(n) OVER (PARTITION BY run_id, community) + sum(n) OVER (PARTITION BY run_id, got) - n) AS j FROM n),
        m AS (SELECT run_id, community, max(j) AS j FROM j GROUP BY ALL),
        a AS (SELECT community, avg(j) AS mj, quantile_cont(j, 0.05) AS lj, avg((j >= 0.75)::INT) AS rec FROM m GROUP BY 1),
        c AS (SELECT community, count(*) AS size, avg((core >= 0.8)::INT) AS cf FROM core GROUP BY 1)
        SELECT community, size, round(mj, 6) AS mean_jaccard, round(lj, 6) AS low_jaccard, round(rec, 6) AS recovery, round(cf, 6) AS core_fraction,
        CASE WHEN mj >= 0.75 AND cf >= 0.8 THEN 'reliable' WHEN mj >= 0.5 THEN 'qualified' ELSE 'unreliable' END AS verdict FROM a JOIN c USING (community)""",
    "sweep_grid": "SELECT k, r AS resolution FROM (VALUES (15::BIGINT), (22), (30), (45), (60)) a(k), (VALUES (0.3::DOUBLE), (0.45), (0.6), (0.9), (1.2)) b(r)",
    "fcs_roundtrip_f": f"SELECT vec_id AS event_id, {_E} FROM embeddings",
    "fcs_roundtrip_d": f"SELECT vec_id AS event_id, {_E} FROM embeddings",
    "fcs_roundtrip_i": "SELECT vec_id AS event_id, " + ", ".join(f"greatest(round_even(embedding[{i + 1}]::DOUBLE * 1000, 0), 0) + 0 AS e{i}" for i in range(DIMS)) + " FROM embeddings",
    "synth_truth_sizes": "SELECT * FROM (VALUES ('CD4 T', 1800::BIGINT), ('CD8 T', 1320), ('B', 1200), ('NK', 780), ('CD4 T activated', 810), ('Rare NKT', 90)) t(population, n)",
    "config_hash": """SELECT substr(sha256('{"a":[1,2],"b":1}'), 1, 16) AS id""",
    "fcs_scan": f"SELECT vec_id AS event_id, {_E} FROM embeddings",
    "fcs_subset": f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS event_id, {_E} FROM embeddings WHERE vec_id % 3 = 0",
    "fcs_channels": f"""WITH m AS ({" UNION ALL ".join(f"SELECT {i + 1} AS place, 'e{i}' AS name, max(greatest(round_even(embedding[{i + 1}]::DOUBLE * 1000, 0), 0)) AS top FROM embeddings" for i in range(DIMS))})
        SELECT place::BIGINT AS place, name, 32::BIGINT AS bits, greatest(top, 1)::DOUBLE AS top, false AS is_log FROM m""",
    "best_jaccard": f"""WITH {_RUNS}, n AS (SELECT run_id, community, got, count(*)::DOUBLE AS n FROM r GROUP BY ALL),
        j AS (SELECT run_id, community, got, n / (sum(n) OVER (PARTITION BY run_id, community) + sum(n) OVER (PARTITION BY run_id, got) - n) AS j FROM n)
        SELECT run_id, community, got AS cand, round(j, 6) AS jaccard FROM j QUALIFY row_number() OVER (PARTITION BY run_id, community ORDER BY j DESC, got) = 1""",
    "neighbour_jaccard": f"""WITH {_near()}, near2 AS (SELECT a.id AS i, b.id AS j, {_DISTANCE["manhattan"]} AS d FROM v a, v b WHERE a.id <> b.id),
        knn2 AS (SELECT i, j FROM near2 QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= {K}),
        b AS (SELECT i, count(*)::DOUBLE AS n FROM knn JOIN knn2 USING (i, j) GROUP BY 1)
        SELECT id AS event_id, round(coalesce(n, 0) / ({2 * K} - coalesce(n, 0)), 6) AS jaccard FROM v LEFT JOIN b ON i = id""",
    "benjamini_hochberg": """WITH t AS (SELECT user_id AS marker, (count(*) * 7 + user_id) % 1000 / 1000.0::DOUBLE AS p FROM events GROUP BY 1),
        r AS (SELECT marker, p, row_number() OVER (ORDER BY p, marker) AS r, count(*) OVER () AS m FROM t)
        SELECT marker, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""",
    "ami": f"""WITH {_TABLE}, a AS (SELECT ref, sum(n) AS x FROM t GROUP BY 1), b AS (SELECT cand, sum(n) AS y FROM t GROUP BY 1), s AS (SELECT sum(n) AS n FROM t),
        mi AS (SELECT sum(t.n / s.n * ln(s.n * t.n / (x * y))) AS mi FROM t JOIN a USING (ref) JOIN b USING (cand), s),
        e AS (SELECT sum(c / n * ln(n * c / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(c + 1) - lgamma(x - c + 1) - lgamma(y - c + 1) - lgamma(n - x - y + c + 1))) AS e
              FROM (SELECT x, y, n, unnest(range(greatest(1, x + y - n)::BIGINT, least(x, y)::BIGINT + 1)) AS c FROM a, b, s)),
        h AS (SELECT (SELECT -sum(x / n * ln(x / n)) FROM a, s) AS ha, (SELECT -sum(y / n * ln(y / n)) FROM b, s) AS hb)
        SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM mi, e, h""",
    "resample_draws": "SELECT run_id, vec_id AS event_id FROM embeddings, range(40) x(run_id) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY md5((1000003 + run_id)::VARCHAR || ':' || vec_id::VARCHAR), vec_id) <= 200",
    "compare_full": f"""WITH s AS (SELECT 'e' || (i - 1) AS marker, i, label, embedding[i]::DOUBLE AS value FROM embeddings, range(1, {DIMS + 1}) x(i) WHERE label IN (0, 1)),
        r AS (SELECT *, rank() OVER (PARTITION BY marker ORDER BY value) + (count(*) OVER (PARTITION BY marker, value) - 1) / 2.0::DOUBLE AS r FROM s),
        x AS (SELECT marker, i, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b, sum(r) FILTER (label = 0) AS ra, median(value) FILTER (label = 0) AS median_a, median(value) FILTER (label = 1) AS median_b, mad(value) FILTER (label = 0) AS mad_a, mad(value) FILTER (label = 1) AS mad_b FROM r GROUP BY 1, 2),
        y AS (SELECT *, 2 * (ra - a * (a + 1) / 2.0::DOUBLE) / (a * b) - 1 AS delta FROM x),
        v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE label IN (0, 1) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id::VARCHAR)) <= 2000),
        p AS (SELECT p.label AS x, q.label AS y, avg(list_distance(p.v, q.v)) AS d FROM v p JOIN v q ON p.label < q.label OR (p.label = q.label AND p.id < q.id) GROUP BY ALL),
        z AS (SELECT greatest(0, 2 * sum(d) FILTER (x <> y) - sum(d) FILTER (x = y)) AS energy FROM p)
        SELECT marker, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(mad_a, 6) AS mad_a, round(mad_b, 6) AS mad_b, round(delta, 6) AS delta,
        CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude, i <= 32 AS used, round(energy, 6) AS energy FROM y, z""",
}
ORACLES["partition_quality"] = ORACLES["quality_modularity"]
ORACLES["leiden_rings"] = ORACLES["relabel_by_size"].replace("n < 50", "n < 10")
