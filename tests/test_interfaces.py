import http.client
import json
import threading

import pytest

import eventloom
from eventloom import errors as err
from eventloom.cli import main
from eventloom.plans import pipeline, report
from eventloom.service import make_server

MARKERS = ("CD3", "CD4", "CD8", "CD19", "CD56")


@pytest.fixture(scope="module")
def demo(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fcs") / "demo.fcs")
    eventloom.write_demo_file(path, 600)
    return path


@pytest.fixture(scope="module")
def result(spark, demo):
    return eventloom.find_communities_in_file(spark, demo, MARKERS, k=10)


def test_names():
    assert all(getattr(eventloom, name) for name in eventloom.__all__)
    with pytest.raises(AttributeError):
        eventloom.nothing


def test_partition(result):
    p = result.partition
    assert isinstance(p, eventloom.Partition) and sum(p.sizes().values()) == 600
    assert p.ids() == tuple(range(p.n_communities())) and p.n_communities() >= 4
    assert p.members(0).count() == p.sizes()[0] and p.n_unassigned() == p.sizes().get(-1, 0)
    assert result.to_dict()["quality"] == pytest.approx(p.quality())
    with pytest.raises(err.CommunityNotFound):
        p.members(99)
    again = eventloom.detect_communities(result.edges, result.space, resolution=0.6)
    assert again.sizes() == p.sizes()


def test_compare(result):
    found = pipeline.compare_communities(result, 0, 1, n_bootstrap=20)
    assert list(found["markers"][0]) == ["marker", "median_a", "median_b", "mad_a", "mad_b", "cliffs_delta", "ci_low", "ci_high", "magnitude", "used_for_clustering", "p_value", "q_value"]
    assert len(found["markers"]) == 9 and abs(found["markers"][0]["cliffs_delta"]) > 0.9 and json.dumps(found)
    text = report.comparison(found)
    assert "| marker |" in text and "CD3*" in text and all(n in text for n in found["notes"])
    only = pipeline.compare_communities(result, 0, 1, markers=["CD3"], inference="split", n_bootstrap=0)
    assert any("no null hypothesis is testable" in n for n in only["notes"])
    for a, b, error in ((0, 99, err.CommunityNotFound), (0, 0, err.ConfigurationError)):
        with pytest.raises(error):
            pipeline.compare_communities(result, a, b)


def test_stability(result):
    found = pipeline.assess_stability(result, n_resamples=2, n_seeds=1, k_values=[10], resolutions=[0.6])
    assert set(found["per_community"][0]) == {"community", "size", "mean_jaccard", "p05_jaccard", "recovery_rate", "core_fraction", "verdict"}
    assert found["sweep"] == [{"k": 10, "resolution": 0.6, "n_communities": result.partition.n_communities(), "ari_vs_reference": 1.0}]
    assert "Seeds alone" in report.stability(found) and json.dumps(found)
    with pytest.raises(err.ConfigurationError, match="n_resamples"):
        pipeline.assess_stability(result, n_resamples=1)


def test_command_line(spark, demo, capsys):
    assert main(["info", demo, "--json"]) == 0 and json.loads(capsys.readouterr().out)["n_events"] == 600
    assert main(["communities", demo, "--k", "10"]) == 0 and "communities over 600 events" in capsys.readouterr().out
    assert main(["communities", demo, "--markers", "CD99"]) == 1 and main(["info", demo + "x"]) == 1
    with pytest.raises(SystemExit) as stop:
        main(["nothing"])
    assert stop.value.code == 2


def _form(**parts):
    out = b""
    for name, value in parts.items():
        extra = b'; filename="up.fcs"' if isinstance(value, bytes) else b""
        out += b'--xx\r\nContent-Disposition: form-data; name="' + name.encode() + b'"' + extra + b"\r\n\r\n" + (value if isinstance(value, bytes) else value.encode()) + b"\r\n"
    return out + b"--xx--\r\n"


def test_endpoint(spark, demo):
    server = make_server(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None, headers=None):
        c = http.client.HTTPConnection(*server.server_address, timeout=120)
        c.request(method, path, body, headers if headers is not None else {"Content-Type": "multipart/form-data; boundary=xx"})
        r = c.getresponse()
        return r.status, json.loads(r.read())

    try:
        raw = open(demo, "rb").read()
        assert ask("GET", "/health") == (200, {"status": "ok", "version": eventloom.__version__})
        status, got = ask("POST", "/communities/sizes", _form(file=raw, markers="CD3, CD4,CD8,CD19,CD56", k="10"))
        assert status == 200 and sum(got["sizes"].values()) == got["n_events"] == 600 and got["provenance"]["source"] == "up.fcs"
        for body, want in (
            (_form(file=b"", markers="CD3"), 400), (_form(file=raw, markers=" , "), 422), (_form(file=b"FCS2.0" + raw[6:], markers="CD3"), 422),
            (_form(file=raw, markers="CD99"), 400), (_form(markers="CD3"), 422), (_form(file=raw, markers="CD3", k="many"), 422),
        ):
            assert ask("POST", "/communities/sizes", body)[0] == want
        assert ask("POST", "/communities/sizes", b"x", {"Content-Type": "text/plain"})[0] == 422
        assert ask("GET", "/other")[0] == ask("POST", "/other", b"")[0] == 404
        assert ask("POST", "/communities/sizes", b"", {"Content-Length": str(1 << 40)})[0] == 413
    finally:
        server.shutdown()
        server.server_close()
