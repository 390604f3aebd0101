"""Language, toxicity, FLAC and the tokenizer against plain versions, and the pipeline on odd tables."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import bpe, flac, language, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def plain_grams(text):
    """Buckets of the n-grams of 1 to 3 lower-cased letters that end at a letter or just behind one, borders as 0."""
    codes = [ord(low) if len(low := c.lower()) == 1 else ord(c) for c in text]
    codes = [x if c.isalpha() else 0 for x, c in zip(codes, text)] + [0]
    out, wrap = Counter(), (1 << 64) - 1
    for i, c in enumerate(codes):
        p = codes[i - 1] if i else 0
        q = codes[i - 2] if i > 1 and p else 0
        if c or p:
            for value, k in ((c, 0x9E3779B97F4A7C15), ((p << 21) + c, 0xC2B2AE3D27D4EB4F), ((((q << 21) + p) << 21) + c, 0x165667B19E3779F9)):
                mixed = value * k & wrap
                mixed ^= mixed >> 29
                out[(mixed * 0xBF58476D1CE4E5B9 & wrap) >> 49] += 1
    return out


def test_language_against_a_plain_bayes(spark, texts):
    rows = [(d, t, "ab"[d % 2]) for d, t in list(texts.items())[:40]] + [(900, "ŉß Ünï 漢字 don't", "a"), (901, "", "b"), (902, "!! 12", "b"), (903, None, "a")]
    for _, t, _ in rows:
        if t:
            assert Counter(language._grams(language._codes([t])[0])[0].tolist()) == plain_grams(t)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {lang: Counter() for lang in "ab"}
    for _, t, lang in rows:
        counts[lang] += plain_grams(t or "")
    logp = lambda lang, g: np.log((counts[lang][g] + language.ALPHA) / (counts[lang].total() + language.ALPHA * language.BUCKETS))
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    for d, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0)
            continue
        total = {lang: sum(n * logp(lang, g) for g, n in plain_grams(t).items()) for lang in "ab"}
        best = max("ab", key=total.get)
        assert got[d].lang_pred == best and got[d].score == pytest.approx(1 / sum(np.exp(x - total[best]) for x in total.values()), abs=1e-3)


def plain_forward(p, x, n):
    """One window's logit by the definition, step by step."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = []
    for d in "fb":
        h, own = np.zeros(toxicity.HIDDEN), {}
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            g = x[t] @ p[f"W{d}"] + p[f"b{d}"]
            z, r = np.split(sig(g[: 2 * toxicity.HIDDEN] + h @ p[f"U{d}"]), 2)
            c = np.tanh(g[2 * toxicity.HIDDEN :] + (r * h) @ p[f"N{d}"])
            own[t] = h = h + z * (c - h)
        states.append([own[t] for t in range(n)])
    s = np.concatenate([np.array(v) for v in states], 1)
    e = (np.tanh(s @ p["A"]) @ p["a"])[:, 0]
    w = np.exp(e - e.max())
    return float((w / w.sum()) @ s @ p["o"][:, 0] + p["c"][0])


def test_network_against_its_definition():
    vocabulary, p = toxicity.train(["a b bad river", "a b c river"] * 40, [1, 0] * 40, passes=1)
    for text in ("bad", "a river b c bad unseen wörds", " ".join(["a", "b", "unseen"] * 20)):
        tokens = [w.encode() for w in text.split()]
        words = toxicity.Words(tokens, vocabulary)
        x = words.inputs(p).astype(float)[: len(tokens)]  # the row behind them is padding
        for i, w in enumerate(tokens):  # an input is the word's row and the mean of its trigrams' rows
            raw = b"\x01" + w + b"\x02"
            grams = [((raw[k] * 65536 + raw[k - 1] * 256 + raw[k - 2]) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 50 for k in range(2, len(raw))]
            assert x[i] == pytest.approx(p["words"][vocabulary.get(w, 0)] + np.mean([p["chars"][g] for g in grams], 0), abs=1e-5)
        got = toxicity._scores((vocabulary, p), [tokens])[1]
        want = [plain_forward(p, x[a : a + toxicity.WINDOW], len(x[a : a + toxicity.WINDOW])) for a in range(0, max(1, len(tokens) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE)]
        assert got == pytest.approx(want, abs=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_model(4).items()}
    words = toxicity.Words([b"ab", b"cd", b"efg"], {b"ab": 1, b"cd": 2})
    ids, mask = np.array([[0, 1, 2, 1], [2, 0, 3, 3]]), np.array([[True] * 4, [True, True, False, False]])
    p["words"][1:3] = rng.normal(size=(2, toxicity.DIM))
    y = np.array([1.0, 0.0])

    def loss():
        got = toxicity.forward(p, words.inputs(p).astype(np.float32), ids, mask).astype(float)
        return float((np.log1p(np.exp(got)) - y * got).sum())

    x = words.inputs(p).astype(np.float32)
    got, kept = toxicity.forward(p, x, ids, mask, keep=True)
    grads = toxicity.backward(p, words, x, ids, kept, toxicity._sigmoid(got) - y)
    for name in ("o", "c", "a", "A", "Uf", "Nb", "Wf", "bb", "words", "chars"):
        flat, g = p[name].reshape(-1), grads[name].reshape(-1)
        for at in rng.choice(np.flatnonzero(np.abs(g) > 1e-2), 3) if (np.abs(g) > 1e-2).any() else ():
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=2e-3), name


def test_toxicity_of_the_whole_table(spark, texts):
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, SF).collect()}
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(toxicity.training_rows(docs), spark.read.parquet(f"{SF}/labels.parquet"))
    for d in list(texts)[::37]:  # a text's score doesn't depend on its batch
        assert toxicity._text_scores(model, pa.array([texts[d]], pa.string()))[0] == pytest.approx(got[d].score, abs=1e-4)
    marks = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    clean = [got[d].predicted for d, t in marks.items() if got[d].held_out and not t]
    assert sum(clean) <= 0.05 * len(clean)


def test_labels_that_are_null_repeated_or_of_no_document(spark):
    docs = spark.createDataFrame([(i, f"the w{i} {'idiot' if i % 2 else 'quiet'} river runs") for i in range(80)] + [(7, None), (None, "x idiot"), (3, "another text of three")], "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS spot")
    labels = [(i, i % 2) for i in range(80)] + [(3, None), (None, 1), (2, 0), (2, 0), (999, 1)]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score(spark.createDataFrame([(1, "a quiet river"), (2, "an idiot river"), (3, None), (4, "")], "doc_id long, text string"), model)
    got = {r.doc_id: r.score for r in rows.collect()}
    assert got[1] < 0.3 <= got[2] and got[3] == got[4]
    for none in ([], [(None, 1)], [(999, 1)], [(1, None)]):
        assert toxicity.fit(docs, spark.createDataFrame(none, "doc_id long, toxic int")) is None


def test_streams_of_the_whole_table(spark, texts):
    for r in flac.op4_media_columns(spark, SF).collect():
        payload, n = flac.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        s = [b - 128 for b in payload]
        assert r.feature == f"mean={sum(s)}/{len(s)};energy={sum(x * x for x in s)};crossings={sum((a < 0) != (b < 0) for a, b in zip(s, s[1:]))}"
        assert r.media_bytes < 1.3 * len(payload) + 200 and len(r.media_sha256) == 64


def noise(n, seed):
    return random.Random(seed).randbytes(n * flac.FRAME)


@pytest.mark.parametrize("points", [flac.POINTS, 3, 1])
def test_seeking_reads_only_the_frames_asked_for(monkeypatch, points):
    monkeypatch.setattr(flac, "POINTS", points)
    monkeypatch.setattr(flac, "SIZES", 6)  # several blocks of sizes
    monkeypatch.setattr(flac, "CHUNK", 4)
    payload = noise(3, 1) + bytes(2 * flac.FRAME) + bytes(range(144)) * 8 + "täxt".encode() * 1152 + noise(6, 2)
    payload = payload[: len(payload) // flac.FRAME * flac.FRAME]
    stream = flac.encode([payload])[0]
    assert flac.decode([stream, stream]) == [payload, payload]
    for first, count in ((0, 1), (575, 2), (576, 576), (1000, 3000), (len(payload) - 5, 99), (0, len(payload)), (-4, 9), (len(payload), 5), (7, 0)):
        low = max(0, first)
        assert flac.read_samples(stream, first, count) == payload[low : max(low, first + count)]
    _, _, start, size = flac._open(stream)
    broken = bytearray(stream)
    broken[start[7] + size[7] // 2] ^= 4  # one frame is damaged: all others can still be read
    assert flac.read_samples(bytes(broken), 0, 7 * flac.FRAME) == payload[: 7 * flac.FRAME]
    assert flac.read_samples(bytes(broken), 8 * flac.FRAME, 999) == payload[8 * flac.FRAME :][:999]
    for read in (lambda: flac.read_samples(bytes(broken), 7 * flac.FRAME, 1), lambda: flac.decode([bytes(broken)])):
        with pytest.raises(flac.CorruptStream):
            read()


def test_damaged_metadata():
    stream = flac.encode([noise(2, 3)])[0]
    for bad in (b"", b"RIFF" + stream[4:], stream[:20], stream[:60], stream[:-1], stream[: len(stream) // 2]):
        with pytest.raises(flac.CorruptStream):
            flac.decode([bad])


def test_pcm_blocks(spark):
    rows = [(1, "some text " * 200), (2, None), (2, ""), (None, "x")]
    media = flac.media_columns(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media"), keep=True)
    got = flac.pcm_blocks(media.unionByName(media.limit(0))).collect()
    whole = b"".join(r.pcm for r in sorted((r for r in got if r.doc_id == 1), key=lambda r: r.sample_offset))
    assert whole == flac.payload_of(rows[0][1])[0] and [r.sample_offset for r in got if r.doc_id == 1] == list(range(0, len(whole), flac.FRAME))
    assert sorted(str(r.doc_id) for r in got if r.doc_id != 1) == ["2", "2", "None"]


def test_tokens_of_the_whole_table(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    for r in bpe.op8_bpe(spark, SF).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tables_of_the_tokenizer_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    monkeypatch.setattr(bpe, "ARCS_KEPT", 50)
    engine = bpe.Automaton(bpe.default_path())
    text = " ".join(f"wörd{i}xyz" for i in range(2000))  # one long text
    ids = engine.encode(text)
    assert len(engine.words) <= 50 and len(engine.arcs) <= 50 and engine.decode(ids) == text
    engine.forget()
    assert not engine.words and not engine.arcs and engine.encode(text) == ids


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long, w int, h long, score double, key long, toxic string, a int, spread int"
    rows = [(1, None, None, None, None, 1, 2, 3.0, 4, "x", 5, 6), (1, "one two three four five six", "en", "s", 27, *[None] * 7), (None, "one two three four five six", *[None] * 10), (2, "", *[None] * 10), (3, "Ünï 漢字 🙂 " * 2000, *[None] * 10)]
    for name, docs in (("odd", rows), ("none", [])):
        path = tmp_path / name
        spark.createDataFrame(docs, columns).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "item_id string, text string, doc_id long").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, toxic int, text string").write.parquet(f"{path}/labels.parquet")
        frame = spark.read.parquet(f"{path}/documents.parquet")
        for stage, fn in corpus_pipeline.STAGES[:-1]:
            frame = fn(spark, frame, str(path))
            assert frame.columns == [c.split()[0] for c in columns.split(", ")], stage
            frame.write.parquet(f"{path}/{stage}")
            frame = spark.read.parquet(f"{path}/{stage}")
        kept = sorted(str(r.doc_id) for r in frame.collect())
        assert kept == (["1", "2", "3", "None"] if docs else [])
        assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(path)).collect()) == kept
