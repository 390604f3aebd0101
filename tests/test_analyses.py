"""Whole analyses: the demo file, split inference, stability, the command line."""

import json

import numpy as np
import pytest

import eventloom
from eventloom import errors as err
from eventloom.cli import main
from eventloom.plans import pipeline
from eventloom.provenance import Provenance
from eventloom.sources import fcs, synth

MARKERS = ("CD3", "CD4", "CD8", "CD19", "CD56")


@pytest.fixture(scope="module")
def groups(spark):
    """Three far groups in X and Y; M is higher in the first, N is noise; both aren't clustered on."""
    rng = np.random.default_rng(4)
    at = np.repeat([(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)], 150, axis=0)
    xy = rng.normal(at + 20, 0.3)
    m, n = rng.normal(0, 1, 450) + 1.5 * (np.arange(450) < 150), rng.normal(0, 1, 450)
    rows = [(i, *map(float, r)) for i, r in enumerate(np.column_stack([xy, m, n]))]
    events = spark.createDataFrame(rows, "event_id long, X double, Y double, M double, N double")
    config = pipeline.CommunityConfig(("X", "Y"), transform="none", k=15, resolution=0.2, min_size=5)
    return pipeline.cluster(events, [(c, None) for c in "XYMN"], config, Provenance("<test>"))


def test_demo_file(spark, tmp_path):
    path = str(tmp_path / "demo.fcs")
    truth = eventloom.write_demo_file(path)
    assert truth.sizes() == {"CD4 T": 1800, "CD8 T": 1320, "B": 1200, "NK": 780, "CD4 T activated": 810, "Rare NKT": 90} and truth.markers == synth.MARKERS
    file = fcs.read_fcs(spark, path)
    assert file.n_events == 6000 and [f"{file.layout.channels[file.index_of(n)].range:.0f}" for n in ("FSC-A", "CD3")] == ["93137", "28512"]
    assert file.index_of("cd4-fitc") == 3 and file.layout.keyword("$FIL") == "demo.fcs" and "seed=20260817" in file.layout.keyword("$SRC")
    result = pipeline.find_communities(file, pipeline.CommunityConfig(MARKERS))
    found = result.to_dict()
    assert found["graph"]["n_edges"] == 121474 and found["n_communities"] == 6
    assert found["quality"] >= 48099.4187 * 0.999
    assert found["provenance"]["source_sha256"] and result.provenance.to_dict()["config"]["k"] == 30
    from eventloom.operators import agreement

    known = spark.createDataFrame([(i, int(x)) for i, x in enumerate(truth.labels)], "event_id long, label int")
    ari = agreement.adjusted_rand(agreement.contingency(known, result.labels.withColumnRenamed("community", "label"))).first().ari
    assert ari == pytest.approx(0.79, abs=0.02)


def test_configuration_id_of_the_demo():
    config = pipeline.CommunityConfig(MARKERS)
    assert config.replace(k=9).k == 9 and Provenance("x", config=config.to_dict()).config_id == Provenance("y", config=dict(reversed(config.to_dict().items()))).config_id


def test_split_inference_tests_what_was_not_clustered_on(groups):
    assert groups.sizes() == {0: 150, 1: 150, 2: 150}
    sides = {r.community for r in groups.labels.where("event_id = 0").collect()}
    a = sides.pop()
    found = pipeline.compare_communities(groups, a, (a + 1) % 3, inference="split", n_bootstrap=50, n_permutations=199)
    by = {m["marker"]: m for m in found["markers"]}
    assert by["M"]["p_value"] == 1 / 200 and by["M"]["q_value"] == pytest.approx(2 / 200) and by["N"]["p_value"] > 0.02 and by["N"]["q_value"] >= by["N"]["p_value"]
    assert by["X"]["p_value"] is None and by["X"]["used_for_clustering"] and not by["M"]["used_for_clustering"]
    assert by["M"]["ci_low"] <= by["M"]["cliffs_delta"] <= by["M"]["ci_high"] and by["M"]["magnitude"] == "large" and by["N"]["magnitude"] in ("negligible", "small")
    assert [abs(m["cliffs_delta"]) for m in found["markers"]] == sorted((abs(m["cliffs_delta"]) for m in found["markers"]), reverse=True)
    again = pipeline.compare_communities(groups, a, (a + 1) % 3, inference="split", n_bootstrap=50, n_permutations=199)
    assert again == found


def test_stability_of_obvious_groups(groups):
    found = pipeline.assess_stability(groups, n_resamples=4, n_seeds=2, k_values=[10, 15], resolutions=[0.1, 0.2])
    assert [r["verdict"] for r in found["per_community"]] == ["reliable"] * 3 and found["boundary_fraction"] == 0
    assert all(r["mean_jaccard"] == 1 and r["core_fraction"] == 1 for r in found["per_community"])
    assert found["seed_ari"]["values"] == [1.0, 1.0] and found["resample_ari"]["min"] == 1 and found["resample_ami"]["mean"] == pytest.approx(1)
    assert [(s["k"], s["resolution"]) for s in found["sweep"]] == [(10, 0.1), (10, 0.2), (15, 0.1), (15, 0.2)]
    # with fewer neighbours a group may fall apart at 0.2, where more communities have the higher quality
    assert [s["n_communities"] for s in found["sweep"]][::2] == [3, 3] and found["sweep"][3]["n_communities"] == 3 and found["sweep"][3]["ari_vs_reference"] == 1
    text = pipeline.stability_of_pair(found, 0, 2)
    assert "community 0: reliable" in text and "community 2: reliable" in text and str(sorted({s["n_communities"] for s in found["sweep"]})) in text
    with pytest.raises(err.CommunityNotFound):
        pipeline.stability_of_pair(found, 0, 7)


def test_draws_are_those_of_single_runs(groups):
    ids = groups.space.select("event_id")
    got = pipeline.draws(ids, 70, 3, 100).collect()
    for r in range(3):
        assert {x.event_id for x in got if x.run_id == r} == {x.event_id for x in pipeline.draw(ids, 70 + r, 100).collect()}


def test_subspace_stage(groups):
    space = eventloom.build_subspace(groups.events, groups.channels, groups.config)
    assert space.columns == ["event_id", "m_0", "m_1"] and space.count() == 450
    with pytest.raises(err.InsufficientData):
        eventloom.build_subspace(groups.events.limit(0), groups.channels, groups.config)


def test_command_line(spark, tmp_path, capsys):
    path, labels = str(tmp_path / "demo.fcs"), str(tmp_path / "labels.npy")
    assert main(["demo", path, "--events", "600"]) == 0 and "CD4 T: 180" in capsys.readouterr().out
    assert main(["communities", path, "--k", "10", "--labels", labels, "--json"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert np.unique(np.load(labels), return_counts=True)[1].sum() == 600 == found["n_events"]
    assert main(["compare", path, "--k", "10", "--a", "0", "--b", "1", "--inference", "split", "--compare-markers", "CD3,Viability"]) == 0 and "| CD3* |" in capsys.readouterr().out
    assert main(["stability", path, "--k", "10", "--resamples", "2", "--seeds", "1", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["n_resamples"] == 2
    with pytest.raises(SystemExit) as stop:
        main(["--version"])
    assert stop.value.code == 0 and eventloom.__version__ in capsys.readouterr().out
