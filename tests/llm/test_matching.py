"""Joins and searches of texts: n-gram Jaccard, licences, decontamination, secrets."""

import random

import duckdb
import pytest

from eventloom.llm import decontaminate, licenses, ngram_join, secrets
from eventloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_whole_tables_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    rows = lambda found, columns: sorted(repr(tuple(dict(zip(columns, r))[k] for k in order)) for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_hot_buckets_keep_every_link(spark, monkeypatch):
    """Buckets cut into parts and blocks of a few classes; links between different components of one bucket are found."""
    monkeypatch.setattr(ngram_join, "BUCKET", 3)
    pick = random.Random(2)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = [f"u{i % 30}_{j}" for j in range(pick.choice((15, 18, 60)))]
        rows.append((i, " ".join(common + own + [f"x{i}"] * (i % 3))))
    want = {}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    want = {d: (len(s), root[d]) for d, s in sets.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(spark.createDataFrame(rows * 2, "doc_id long, text string")).collect()}
    assert got == want and len(set(root.values())) > 1


def test_keep_one_takes_a_stated_row(spark):
    rows = [(2, "b b b b b b", "x"), (2, "a a a a a a", "y"), (2, None, "z"), (1, None, "p"), (1, "", "q"), (None, "a a a a a a", "n"), (None, None, "m")]
    for turn in (rows, rows[::-1]):
        docs = spark.createDataFrame(turn, "doc_id long, text string, r string").withColumn("a", __import__("pyspark").sql.functions.lit(1))
        got = ngram_join.keep_one(docs)
        assert got.columns == docs.columns and sorted(r.r for r in got.collect()) == ["m", "n", "q", "y"]


def test_scratch_tables_go(spark):
    import os

    from eventloom.llm.common import shared_folder

    left = lambda: {f for f in os.listdir(shared_folder(spark)) if f.startswith("scratch")}
    before = left() if os.path.isdir(shared_folder(spark)) else set()
    ngram_join.link_components(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert left() <= before


def plain_labels(words, passages):
    """Every start of every passage, by its anchors and key phrase alone; the share of equal words."""
    found, best = set(), 0.0
    for t in licenses.build_index(passages):
        for s in range(len(words) - len(t.words) + 1):
            anchored = all(words[s + at] == w for w, at in t.anchors)
            if anchored and tuple(words[s + t.key_at : s + t.key_at + len(t.key)]) == t.key:
                found.add(t.label)
                best = max(best, sum(a == b for a, b in zip(words[s:], t.words)) / len(t.words))
    return ",".join(sorted(found)), best


def test_licence_passages_against_every_place(spark):
    pick = random.Random(4)
    passages = [*((label, p, p) for label, p in licenses.BASE), *licenses.MORE]
    rows = []
    for i in range(120):
        words = [pick.choice(["the", "license", "river", "of", "software", "by", "cc"]) for _ in range(pick.randrange(30))]
        passage = pick.choice(passages)[1].split()
        for _ in range(pick.randrange(3)):  # a word of the passage is lost or another stands for it
            at = pick.randrange(len(passage))
            passage[at : at + 1] = pick.choice(([], ["word"]))
        at = pick.randrange(len(words) + 1)
        rows.append((i, ", ".join([*words[:at], *passage, *words[at:], "end"]).upper()))
    rows += [(900, None), (901, ""), (902, "cc"), (903, "general " * 5000 + "public license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS m", "3 AS score")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    want = {d: plain_labels((t or "").lower().replace(",", "").split(), passages) for d, t in rows}
    assert got == {d: (names, pytest.approx(s)) for d, (names, s) in want.items()}
    assert len({n for n, _ in want.values()}) > 8 and any(0 < s < 1 for _, s in want.values())


def test_licence_templates_share_anchors_and_need_the_key_phrase():
    for t in licenses.build_index(licenses.MORE):
        assert len(t.anchors) == min(len(t.words), licenses.ANCHORS) and all(t.words[at] == w for w, at in t.anchors)
    with pytest.raises(ValueError, match="key phrase"):
        licenses.build_index([("x", "a b c", "a c")])


def test_blocks_of_a_benchmark_do_not_change_the_result(spark):
    pick = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    prose = lambda n: " ".join(pick.choices(words, k=n))
    items = [(1, prose(5)), (2, prose(200)), (2, prose(40)), (3, prose(13)), (3, None), (None, prose(9)), (4, ""), (5, prose(3)), (5, prose(3))]
    items += [items[1]] * 3  # rows that repeat
    texts = [t for _, t in items if t]
    rows = [(i, f"{prose(20)} {pick.choice(texts)[pick.randrange(40) :]} {prose(20)}") for i in range(60)] + [(1, None), (None, texts[0]), (2, ""), (3, texts[2]), (3, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS h", "1 AS n_hit")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS h", "2 AS doc_id")
    runs = []
    for chars in (decontaminate.BLOCK_CHARS, 300, 60):
        found = decontaminate.decontaminate(docs, bench, block_chars=chars).drop("spans")
        kept = decontaminate.drop_contaminated(docs, bench, block_chars=chars)
        assert kept.columns == docs.columns
        runs.append((sorted(map(repr, map(tuple, found.select(sorted(found.columns)).collect()))), sorted(map(repr, map(tuple, kept.collect())))))
    assert runs[0] == runs[1] == runs[2] and 0 < len(runs[0][1]) < len(rows)
    # against every place of every window, short items too
    for r in decontaminate.decontaminate(docs, bench).collect():
        assert r.n_items == len(r["items"]) and (r.n_hit > 0) == bool(r["items"])


def test_pieces_hold_every_window():
    pick = random.Random(1)
    for n, most, window in ((400, 100, 13), (90, 30, 3), (60, 10, 13), (13, 5, 13), (1, 1, 13)):
        words = [f"w{pick.randrange(50)}" for _ in range(n)]
        cut = [p.split() for p in decontaminate._pieces(" ".join(words), window, most)]
        windows = lambda w: {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}
        assert set().union(*map(windows, cut)) == windows(words)


def test_every_credential_value_is_costed(spark):
    text = "password=Xk29vLqT81mZ and token: deadbeef00112233445566778899"
    assert [(k, text[a:b]) for a, k, b in secrets.scan_text(text)[1] if k == "guess"] == [("guess", "Xk29vLqT81mZ"), ("guess", "deadbeef00112233445566778899")]
    assert secrets.guess_cost("passwordx") == pytest.approx(secrets.guess_cost("password") + secrets._space("x") + 0.30103, abs=1e-4)
    assert secrets.guess_cost("abcabcabcabcabc") < 5 < secrets.guess_cost("xk2vqz7mtw")
    assert secrets.guess_cost("a" * 70) < secrets.guess_cost("a" * 60) + 0.1
    few = secrets.Dictionary(["kqzvxwjy"])
    assert secrets.guess_cost("kqzvxwjy", words=few) < 1 < secrets.guess_cost("kqzvxwjy")
    assert sum(r.n_guess for r in secrets.op5_secret_scans(spark, SF).collect()) > 0
