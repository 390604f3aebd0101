"""Whole analyses: file to communities, comparison of two communities, stability of a partition."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.errors import CommunityNotFound, ConfigurationError, InsufficientData
from eventloom.operators import agreement, communities, compare, graph
from eventloom.operators.subspace import dense, require_events, resolve_all, select_subspace, subset
from eventloom.plans.lineage import cut
from eventloom.provenance import Provenance
from eventloom.sources.fcs import FCSFile, read_fcs


EFFECT_NOTE = "Cliff's delta is the chance that a value of A exceeds one of B less the chance of the reverse; its interval is a bootstrap over events."
CIRCULAR_NOTE = "Markers with * were used for clustering: their rows are descriptive and have no p-value."


#: Names and defaults are the interface's: fixed values.
@dataclass(frozen=True)
class CommunityConfig:
    markers: tuple[str, ...]
    transform: str = "asinh"
    cofactor: float = 250.0
    scaling: str = "zscore"
    k: int = 30
    weighting: str = "jaccard"
    metric: str = "euclidean"
    prune_below: float = 1 / 15
    resolution: float = 0.6
    objective: str = "modularity"
    seed: int = 0
    min_size: int = 10

    def replace(self, **more) -> CommunityConfig:
        return replace(self, **more)

    def to_dict(self) -> dict:
        return {**asdict(self), "markers": list(self.markers)}


@dataclass
class Partition:
    """Communities of a graph's events: raw labels, and labels by size with -1 for events of small communities."""

    edges: DataFrame
    raw: DataFrame
    labels: DataFrame
    resolution: float = 1.0
    seed: int = 0
    objective: str = "modularity"

    def sizes(self) -> dict[int, int]:
        """Events of each community, by id, the unassigned last."""
        found = {r.community: r.n for r in communities.sizes(self.labels).collect()}  # a row a community
        return {c: found[c] for c in sorted(found, key=lambda c: (c < 0, c))}

    def ids(self) -> tuple[int, ...]:
        return tuple(c for c in self.sizes() if c != communities.UNASSIGNED)

    def n_communities(self) -> int:
        return len(self.ids())

    def n_unassigned(self) -> int:
        return self.sizes().get(communities.UNASSIGNED, 0)

    def members(self, community: int) -> DataFrame:
        return communities.members(self.labels, community)

    def quality(self) -> float:
        named = self.raw.select("event_id", F.col("raw").alias("community"))
        return communities.quality(self.edges, named, resolution=self.resolution, objective=self.objective).first()["quality"]


@dataclass
class CommunityResult:
    config: CommunityConfig
    provenance: Provenance
    events: DataFrame
    channels: list[tuple[str, str | None]]
    space: DataFrame
    edges: DataFrame
    raw: DataFrame
    labels: DataFrame
    notes: list[str] = field(default_factory=list)

    @property
    def partition(self) -> Partition:
        return Partition(self.edges, self.raw, self.labels, self.config.resolution, self.config.seed, self.config.objective)

    def sizes(self) -> dict[int, int]:
        return self.partition.sizes()

    def quality(self) -> float:
        return self.partition.quality()

    def to_dict(self) -> dict:
        n, sizes = self.space.count(), self.sizes()
        stats = graph.graph_stats(self.edges, n).first().asDict()
        return {"n_events": n, "n_communities": sum(c >= 0 for c in sizes), "sizes": {str(c): s for c, s in sizes.items()}, "quality": self.quality(), "objective": self.config.objective, "resolution": self.config.resolution, "seed": self.config.seed, "provenance": self.provenance.to_dict(), "config": self.config.to_dict(), "graph": stats}


def detect_communities(edges: DataFrame, events: DataFrame, *, resolution: float = 1.0, seed: int = 0, objective: str = "modularity", n_iterations: int = 5, min_size: int = 10) -> Partition:
    """The communities of one graph: edges (src, dst, w) over events (event_id)."""
    one = lambda d: d.select(F.lit(0).cast("long").alias("run_id"), "*")
    raw = communities.detect(one(edges), one(events.select("event_id")), resolution=resolution, seed=seed, objective=objective, n_iterations=n_iterations).drop("run_id")
    raw = cut(raw)
    return Partition(edges, raw, communities.relabel(raw, min_size), resolution, seed, objective)


def partition(space: DataFrame, config: CommunityConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, raw labels, labels) of a subspace."""
    edges = graph.build_graph(space, k=config.k, weighting=config.weighting, metric=config.metric, prune_below=config.prune_below)
    edges = cut(edges)
    found = detect_communities(edges, space, resolution=config.resolution, seed=config.seed, objective=config.objective, min_size=config.min_size)
    return edges, found.raw, found.labels


def build_subspace(events: DataFrame, channels: list[tuple[str, str | None]], config: CommunityConfig) -> DataFrame:
    """The subspace half of a configuration: event_id and the transformed, scaled markers."""
    require_events(events)
    return select_subspace(events, resolve_all(config.markers, channels), transform=config.transform, cofactor=config.cofactor, scaling=config.scaling)


def cluster(events: DataFrame, channels: list[tuple[str, str | None]], config: CommunityConfig, provenance: Provenance) -> CommunityResult:
    space = cut(build_subspace(events, channels, config))
    edges, raw, labels = partition(space, config)
    return CommunityResult(config, provenance.derive(**config.to_dict()), events, channels, space, edges, raw, labels)


def find_communities(file: FCSFile, config: CommunityConfig) -> CommunityResult:
    return cluster(file.events, [(c.name, c.stain) for c in file.layout.channels], config, file.provenance)


def find_communities_in_file(spark: SparkSession, path: str, markers, **more) -> CommunityResult:
    return find_communities(read_fcs(spark, path), CommunityConfig(tuple(markers), **more))


def _long(events: DataFrame, names: list[str], labels: DataFrame, a: int, b: int) -> DataFrame:
    """(marker, side, value) of the events of two communities, from transformed columns m_i."""
    side = F.when(F.col("community") == a, "a").when(F.col("community") == b, "b")
    rows = events.join(labels, "event_id").withColumn("side", side).where("side is not null")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("marker"), F.col(f"m_{i}").alias("value")) for i, n in enumerate(names)]))
    return rows.select("side", pairs.alias("x")).select("x.marker", "side", "x.value")


def compare_communities(result: CommunityResult, a: int, b: int, *, markers=None, inference: str = "descriptive", n_bootstrap: int = 500, n_permutations: int = 999, seed: int = 0, max_pairs: int = 2000) -> dict:
    """Effect sizes of all markers between two communities; with ``split`` also p and q of markers that weren't clustered on."""
    if inference not in ("descriptive", "split"):
        raise ConfigurationError(f"inference {inference!r}")
    sizes = result.sizes()
    for c in (a, b):
        if c < 0 or c not in sizes:
            raise CommunityNotFound(f"no community {c}")
        if sizes[c] < 3:
            raise InsufficientData(f"community {c} has {sizes[c]} events")
    if a == b:
        raise ConfigurationError("a community is compared with itself")
    names = resolve_all(markers or [c[0] for c in result.channels], result.channels)
    used = set(resolve_all(result.config.markers, result.channels))
    space = select_subspace(result.events, names, transform=result.config.transform, cofactor=result.config.cofactor, scaling="none")
    rows = cut(_long(space, names, result.labels, a, b))
    table = compare.cliffs_delta(rows).join(compare.bootstrap_ci(rows, n_bootstrap, seed), "marker") if n_bootstrap > 0 else compare.cliffs_delta(rows).select("*", F.lit(float("nan")).alias("ci_low"), F.lit(float("nan")).alias("ci_high"))
    found = {r.marker: r.asDict() for r in table.withColumn("magnitude", compare.magnitude(F.col("delta"))).collect()}
    for r in compare.medians(rows).collect():
        found[r.marker] |= {f"median_{r.side}": r.median, f"mad_{r.side}": r.mad}
    notes, tests = [EFFECT_NOTE, CIRCULAR_NOTE], {}
    if inference == "split":
        tests, more = _split(result, a, b, [n for n in names if n not in used], space, names, n_permutations, seed)
        notes += more
    else:
        notes.append("No p-values were asked for: a test on the events that were clustered is circular; split inference tests other markers.")
    if used.issuperset(names):
        notes.append("All markers compared were used for clustering: their differences restate the clustering.")
    side = lambda c: compare.thin(graph.vectors(space).join(result.labels.where(F.col("community") == c).select("event_id"), "event_id"), max_pairs, seed)
    energy = compare.energy_distance(side(a), side(b)).first()["energy"]
    shown = ("median_a", "median_b", "mad_a", "mad_b", "cliffs_delta", "ci_low", "ci_high", "magnitude")
    listed = []
    for n in names:
        row = found[n] | {"cliffs_delta": found[n]["delta"]}
        p, q = tests.get(n, (None, None))
        listed.append({"marker": n, **{c: row[c] for c in shown}, "used_for_clustering": n in used, "p_value": p, "q_value": q})
    return {"community_a": a, "community_b": b, "n_a": sizes[a], "n_b": sizes[b], "energy_distance": energy, "inference": inference, "markers": sorted(listed, key=lambda m: -abs(m["cliffs_delta"])), "notes": notes, "provenance": result.provenance.derive(comparison_seed=seed, comparison_inference=inference).to_dict()}


def _split(result, a, b, testable, space, names, n_permutations, seed, least: float = 0.5):
    """p and q by marker from held-out halves, or the reason why there are none."""
    if not testable:
        return {}, ["no null hypothesis is testable: all markers were used for clustering"]
    half = F.pmod(F.xxhash64(F.lit(seed + 977), "event_id"), F.lit(2)) == 0
    ids = cut(result.space.select("event_id", half.alias("train")))
    kept = result.space.join(ids.where("train"), "event_id", "left_semi")
    numbered = cut(dense(kept.withColumn("own", F.col("event_id"))))
    _, _, labels = partition(numbered.drop("own"), result.config)
    labels = cut(labels.join(numbered.select("event_id", "own"), "event_id").select(F.col("own").alias("event_id"), F.col("community").alias("label")))
    reference = result.labels.select("event_id", F.col("community").alias("label"))
    table = agreement.contingency(reference, labels).where("cand >= 0")
    match = {r.ref: r.cand for r in compare.best_match(table, least).where(F.col("ref").isin(a, b)).collect()}
    if len(match) < 2 or match[a] == match[b]:
        return {}, ["the communities were not found again in the training half"]
    train = graph.vectors(result.space.join(ids.where("train"), "event_id", "left_semi"))
    test = graph.vectors(result.space.join(ids.where("not train"), "event_id", "left_semi"))
    voted = compare.vote(test, train, labels, result.config.k, result.config.metric).select("event_id", F.col("label").alias("community"))
    rows = cut(_long(space, names, voted, match[a], match[b]).where(F.col("marker").isin(testable)))
    count = {r.side: r["count"] for r in rows.where(F.col("marker") == testable[0]).groupBy("side").count().collect()}
    if min(count.get("a", 0), count.get("b", 0)) < 20:
        return {}, ["fewer than 20 held-out events in a community"]
    q = compare.benjamini_hochberg(compare.permutation_p(rows, n_permutations, seed + 4159))
    return {r.marker: (r.p, r.q) for r in q.collect()}, ["p-values are of held-out events and of markers that were not clustered on"]


def assess_stability(result: CommunityResult, *, n_resamples: int = 40, subsample_fraction: float = 0.8, n_seeds: int = 5, k_values=None, resolutions=None, seed: int = 0) -> dict:
    """Evidence from subsamples, seeds and parameters.

    Neighbours are searched once, more of them than k: those of a subsample, and of each k of the parameter sweep, are among them.
    One job clusters all subsamples, a task each, and one the sweep; the evidence is aggregated by run.
    So the number of jobs and plans doesn't grow with the runs.
    """
    if not 0.1 <= subsample_fraction < 1:
        raise ConfigurationError("subsample_fraction must be within 0.1 and 1")
    if n_resamples < 2:
        raise ConfigurationError("n_resamples must be at least 2")
    config, n = result.config, result.space.count()
    take = max(config.k + 1, round(subsample_fraction * n))
    spark = result.space.sparkSession
    reference = cut(result.labels.select("event_id", F.col("community").alias("label")))
    v = graph.vectors(result.space)
    drawn = cut(draws(result.space.select("event_id"), seed * 1_000_003, n_resamples, take))
    grid, ks = [float(g) for g in resolutions or agreement.resolution_grid(config.resolution)], [k for k in k_values or agreement.k_grid(config.k) if k < n]
    near = cut(graph.knn(result.space, min(n - 1, max([graph.enough(config.k, take / n), *ks])), config.metric))
    lists = graph.lists_of_runs(near, drawn, v, n_resamples, config.k, config.metric)
    weights = {"weighting": config.weighting, "prune_below": config.prune_below, "objective": config.objective}
    job = lambda r, k, g: (r, k, float(g), config.seed)
    table_of = lambda jobs: spark.createDataFrame(jobs, "run_id long, k long, resolution double, seed long")
    raw = communities.detect_lists(lists, table_of([job(r, config.k, config.resolution) for r in range(n_resamples)]), **weights)
    found, table = _against(reference, raw, config)
    best = agreement.best_jaccard(table)
    runs = F.broadcast(spark.range(n_resamples).select(F.col("id").alias("run_id")))
    every = reference.where("label >= 0").select(F.col("label").alias("community")).distinct().crossJoin(runs)
    matches = cut(every.join(best, ["run_id", "community"], "left").select("run_id", "community", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), "cand"))
    own = reference.join(found.withColumnRenamed("label", "got"), "event_id").join(matches.select("run_id", F.col("community").alias("label"), "cand"), ["run_id", "label"], "left")
    hits = own.select("event_id", F.col("label").alias("community"), F.coalesce((F.col("label") >= 0) & (F.col("got") == F.col("cand")), F.lit(False)).alias("hit"))
    cores = cut(reference.join(agreement.core_scores(hits), "event_id", "left").select("event_id", F.col("label").alias("community"), F.coalesce("core", F.lit(-1.0)).alias("core")))
    ari = [r.ari for r in agreement.adjusted_rand(table).collect()]  # a row a run
    ami = [r.ami for r in agreement.adjusted_mutual_info(table).collect()]
    rows = agreement.summary(matches, cores.where("community >= 0 and core >= 0")).withColumnsRenamed({"low_jaccard": "p05_jaccard", "recovery": "recovery_rate"})
    per = [r.asDict() for r in rows.orderBy("community").collect()]  # a row a community
    boundary = agreement.boundary_fraction(cores).first()[0]
    seed_ari = []
    if n_seeds:
        again = spark.range(n_seeds).select(F.col("id").alias("run_id"), (F.col("id") + config.seed + 1).alias("seed"))
        found, table = _against(reference, _many(result.edges, result.space, again, config.resolution, config), config)
        seed_ari = [r.ari for r in agreement.adjusted_rand(table).orderBy("run_id").collect()]
    sweep = []
    if ks and grid:
        jobs = table_of([job(i * len(grid) + x, k, g) for i, k in enumerate(ks) for x, g in enumerate(grid)])
        every = result.space.select("event_id").join(graph.listed_near(near), "event_id", "left")
        first = lambda c, t: F.coalesce(F.slice(c, F.lit(1), F.col("k").cast("int")), F.array().cast(f"array<{t}>")).alias(c)
        lists = cut(every).crossJoin(F.broadcast(jobs)).select("run_id", "event_id", first("js", "long"), first("ds", "double"))
        raw = communities.detect_lists(lists, jobs, **weights)
        found, table = _against(reference, raw, config)
        counts = {r.run_id: r.n for r in table.where("cand >= 0").groupBy("run_id").agg(F.countDistinct("cand").alias("n")).collect()}
        agreed = {r.run_id: r.ari for r in agreement.adjusted_rand(table).collect()}
        sweep = [{"k": k, "resolution": g, "n_communities": counts.get(i * len(grid) + x, 0), "ari_vs_reference": agreed[i * len(grid) + x]} for i, k in enumerate(ks) for x, g in enumerate(grid)]
    return {"reference_sizes": {str(c): s for c, s in result.sizes().items()}, "n_resamples": n_resamples, "subsample_fraction": subsample_fraction, "resample_ari": {"mean": sum(ari) / len(ari), "min": min(ari)}, "resample_ami": {"mean": sum(ami) / len(ami)}, "seed_ari": {"values": seed_ari, "min": min(seed_ari, default=None)}, "per_community": per, "boundary_fraction": boundary, "sweep": sweep, "config": config.to_dict()}


def _against(reference: DataFrame, raw: DataFrame, config: CommunityConfig) -> tuple[DataFrame, DataFrame]:
    """(labels by run, contingency with the reference by run) of raw clusterings by run."""
    found = cut(communities.relabel(cut(raw), config.min_size).withColumnRenamed("community", "label"))
    return found, cut(agreement.contingency(reference, found))


def _many(edges: DataFrame, space: DataFrame, runs: DataFrame, resolution: float, config: CommunityConfig) -> DataFrame:
    """Clusterings of one graph by several (run_id, seed[, resolution]); a copy of the graph goes to each run's task."""
    few = F.broadcast(runs)
    return communities.detect(edges.crossJoin(F.broadcast(runs.select("run_id"))), space.select("event_id").crossJoin(few), resolution=resolution, seed=config.seed, objective=config.objective)


def draw(ids: DataFrame, seed: int, take: int) -> DataFrame:
    """``take`` ids without replacement, by the md5 of seed and id; the same in any partitioning."""
    return ids.select("event_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("event_id").cast("string"))), "event_id").limit(take)


def draws(ids: DataFrame, seed: int, n_runs: int, take: int) -> DataFrame:
    """(run_id, event_id): for each run r what ``draw`` takes with seed + r."""
    runs = F.broadcast(ids.sparkSession.range(n_runs).select(F.col("id").alias("run_id")))
    key = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("run_id")).cast("string"), F.col("event_id").cast("string")))
    order = Window.partitionBy("run_id").orderBy(key, "event_id")  # a run must fit one task for its clustering
    return ids.select("event_id").crossJoin(runs).withColumn("place", F.row_number().over(order)).where(F.col("place") <= take).select("run_id", "event_id")


def stability_of_pair(evidence: dict, a: int, b: int) -> str:
    per = {r["community"]: r for r in evidence["per_community"]}
    if a not in per or b not in per:
        raise CommunityNotFound(f"no evidence on {a} or {b}")
    counts = sorted({s["n_communities"] for s in evidence["sweep"]})
    return "; ".join(f"community {c}: {per[c]['verdict']}, mean Jaccard {per[c]['mean_jaccard']:.2f}" for c in (a, b)) + f"; community counts in the sweep: {counts}"
