import hashlib
import re
import zlib

import duckdb
import pytest

from eventloom.llm import bpe, decontaminate, flac, html_text, language, licenses, ngram_join, secrets, toxicity, urls

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None), (2, "", "x"), (2, "", "x"), (3, "   \n", "x"), (4, "Ünï 漢字 🙂 " * 3000, "x"), (None, "one two three four five six", "x"), (5, "!!!", "x"), (5, "one two three four five six", "x")]
DOCS = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_odd_rows(spark):
    odd, none = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([(1, "one two three four five"), (1, None), (None, "six"), (2, "")], "item_id long, text string")
    model = toxicity.train(["a b bad", "a b c"] * 3, [1, 0] * 3, passes=1)
    marked = lambda d: d.withColumn("lang", d.score)
    for run in (
        lambda d: language.predict(d, language.train(marked(d))), ngram_join.link_components, lambda d: toxicity.score(d, model), lambda d: toxicity.score(d, None), flac.media_columns,
        secrets.scan_secrets, licenses.scan_licenses, lambda d: bpe.encode_documents(d, bpe.default_path()), lambda d: decontaminate.decontaminate(d, bench),
        lambda d: decontaminate.decontaminate(d.where("doc_id is null or doc_id <> 2"), bench, block_chars=10).union(decontaminate.decontaminate(d.where("doc_id = 2"), bench)),
    ):
        assert len(run(odd).collect()) == len(ODD)
        assert run(none).collect() == []
    pages = spark.createDataFrame([(1, None, None), (1, "no host", "<p"), (2, "HTTP://A.com", ""), (2, "x://a..com/en/1", "<p>a")], "page_id long, url string, html string")
    assert len(html_text.extract_main_text(pages).collect()) == 4
    assert sorted(r.verdict for r in urls.judge_urls(pages).collect()) == ["allow", "allow", "allow", "block"]


def test_language_held_out(spark):
    got = [r for r in language_rows(spark) if r.held_out]
    want = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)


def language_rows(spark):
    return language.op1_language_id(spark, SF).collect()


def test_jaccard_against_all_pairs(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[: 100 + i])) for i in range(40)] + [(100 + i, " ".join(words[200:260] + [f"u{i}_{j}" for j in range(60)])) for i in range(30)]
    rows += [(200, "a b"), (201, "A  b"), (202, "a b c"), (203, None), (204, ""), (205, rows[0][1]), (206, rows[0][1].upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {d: (len(sets[d]), root[d]) for d in sets}


def test_sketches_bound_the_difference(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    pairs, sketches, linked = [], [], set()
    for i, (n, drop, new) in enumerate([(600, 20, 20), (1000, 60, 100), (1030, 30, 0), (1030, 200, 5), (4000, 0, 500), (4000, 1600, 1600), (2100, 2000, 2000)]):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 64, new, np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert sum(bin(int(x) & (1 << 64) - 1).count("1") for x in ngram_join.sketch_of(a) ^ ngram_join.sketch_of(b)) <= apart
        pairs.append((2 * i, 2 * i + 1, len(a), len(b)))
        sketches += [(2 * i, ngram_join.wide_sketch_of(a).tolist()), (2 * i + 1, ngram_join.wide_sketch_of(b).tolist())]
        if 7 * apart <= len(a) + len(b):
            linked.add(2 * i)
    kept = {r.a for r in ngram_join.close(spark.createDataFrame(pairs, "a long, b long, na long, nb long"), spark.createDataFrame(sketches, "key long, wide array<long>")).collect()}
    assert linked <= kept and 0 < len(linked) < len(pairs) and not kept & {10, 12}


def test_flac():
    payloads = [flac.payload_of(t)[0] for t in (None, "", "é" * 1000, "x" * 576, "Some text, with words. " * 99)]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    for at in (-1, -40):
        bad = bytearray(streams[-1])
        bad[at] ^= 1
        with pytest.raises(flac.CorruptStream):
            flac.decode([bytes(bad)])


def test_secrets_against_plain_patterns(spark, texts):
    base = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    for r in secrets.op5_secret_scans(spark, SF).collect():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(base) for m in p.finditer(texts[r.doc_id] or "") if len(m[g]) >= n)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{base[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    assert secrets.guess_cost("password") < secrets.guess_cost("Passw0rd1999") < secrets.guess_cost("x9$Kq2!vLw7#") and secrets.guess_cost("aaaaaaaaaa") < 4
    assert [k for _, k, _ in secrets.scan_text("pwd: x9$Kq2vLw7Zr and password=hunter22")[1]] == ["guess", "assign"]


def test_licenses_against_word_search(spark, texts):
    for r in licenses.op7_license_scans(spark, SF).collect():
        w = WORD.findall(lower(texts[r.doc_id]))
        at = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))


def test_bpe_against_the_library(texts):
    from tokenizers import Tokenizer

    engine, other = bpe.Automaton(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    for t in [*list(texts.values())[:300], "<|endoftext|> a<|endoftext|>", "a" * 999, " \u2003\x85\x1c \n\n x", "🙂漢'll ½²"]:
        ids = engine.encode(t)
        assert list(ids) == other.encode(t, add_special_tokens=False).ids and engine.decode(ids) == t


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p><b>One.<br><p>Two\n  three.</p><div class='comments'><p>me too</p></div></article><footer>&copy;</footer>"
    assert html_text.main_text(page) == "A & B One. Two three."
    assert html_text.main_text(None) == html_text.main_text("") == ""
    long = "A long line of the text that is surely the main one, with many words. " * 3
    assert html_text.main_text(f"<div>home</div><p>x</p><br><br><div class=sidebar>{long}</div><p>{long}</p>").endswith(long.strip())


def test_decontamination_against_every_place(spark, texts):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for a in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    for r in decontaminate.op10_benchmark_decontamination(spark, SF).collect():
        w = WORD.findall(lower(texts[r.doc_id]))
        hit, found = set(), set()
        for a in range(len(w) - 12):
            if names := windows.get(tuple(w[a : a + 13])):
                hit |= set(range(a, a + 13))
                found |= names
        assert (r.n_words, r.n_hit, r.items_sha256) == (len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))


def test_urls_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = c.sql(urls.OP6_SQL).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in urls.op6_url_filters(spark, SF).collect())


def test_toxicity_learns():
    clean, bad = [f"the quiet w{i} river runs" for i in range(150)], [f"the w{i} idiot river runs" for i in range(150)]
    model = toxicity.train(clean + bad, [0] * 150 + [1] * 150)
    import pyarrow as pa

    got = toxicity._text_scores(model, pa.array(["a quiet river", "what an idiot river", "calm words " * 200 + "idiot"]))
    assert got[0] < toxicity.THRESHOLD <= min(got[1], got[2])


def test_redaction(spark, docs):
    rows = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert len(rows) == 1000 and all(not secrets.scan_text(r.text)[0] and r.n_chars == len(r.text) for r in rows.values())


@pytest.mark.parametrize(
    "text, value",
    [
        ('secret = "q$7Kz!2vLw9#"', "q$7Kz!2vLw9#"), ("password=abcdef!Xy9$kqTz#8 and", "abcdef!Xy9$kqTz#8"), ("db_password: k#v,xq;z<wp.", "k#v,xq;z<wp"), ("pwd: k#v!xq$z%wp", "k#v!xq$z%wp"),
        ("login is 8395317460527", "8395317460527"), ("login password: x9$Kq2!vLw7#", "x9$Kq2!vLw7#"), ('{"token":"k#v!xq\\"z%wp","n":1}', 'k#v!xq\\"z%wp'), ("pwd: x-0123456789abcdef01234567-Q!", "x-0123456789abcdef01234567-Q"),
    ],
)
def test_whole_credential_values(spark, text, value):
    assert [text[a:b] for a, k, b in secrets.scan_text(text)[1] if k == "guess"] == [value]
    row = secrets.redact(spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")).first()
    assert value[-4:] not in row.text and row.n_chars == len(row.text)


def test_guessable_values_and_prose_are_no_secrets():
    for text in ("password: P@ss,w0", "pwd: 11111111111111", "login user-friendly (optional), and/or", "the secret is well-known.", "pwd: (optional)", "password: [secret]", "pwd: mandatory!", "credentials: पासवर्ड"):
        assert [k for _, k, _ in secrets.scan_text(text)[1] if k == "guess"] == [], text


def test_many_contexts_in_one_run():
    text = "password=" * 50_000 + " " + "pwd:'a" * 50_000 + " token=abcdef" * 50_000
    assert len(secrets.scan_text(text)[0]) == 50_001


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "header-fixed", "search-results", "has-comments"])
def test_names_round_an_article_do_not_empty_the_page(name):
    for tag in ("article", "main"):
        page = f"<html><body><div id=page class='{name}'><div class=ad>buy</div><{tag}><h1>A</h1><p>text</p><div class=comments><article>me too</article></div></{tag}><div class=related><article>other</article></div></div>"
        assert html_text.main_text(page) == "A text", tag
    assert html_text.main_text(f"<div class='{name}'><main><p>text</p></main></div><article>x</article>") == "text x"


def test_names_round_other_articles_still_exclude():
    long = "A long line of the text that is surely the main one, with many words. " * 3
    for name in ("sidebar", "comments", "related"):
        assert html_text.main_text(f"<p>{long}</p><div class={name}><article>other</article></div>") == long.strip()
        assert html_text.main_text(f"<article>text</article><div class={name}><article>{long}</article></div>") == "text"


def test_head_without_end_tag():
    for body in ("<body><article><p>text", "<article>text</article>", "<main><br>text", "<meta charset=x><body class=x><main>text</main></body>"):
        assert html_text.main_text(f"<html><head><title>t</title><style>p{{}}</style>\n{body}") == "text"
    long = "A long line of the text that is surely the main one, with many words. "
    assert html_text.main_text(f"<head><title>t</title>{long}<p>x") == long + "x" and html_text.main_text(f"<head>{long}") == long.strip()


def test_contaminated_rows_go_by_their_own_text(spark):
    bad, clean = "one two three four five six", "seven eight nine"
    rows = [(1, bad, "a"), (1, clean, "b"), (1, clean, "b"), (None, bad, "c"), (None, clean, "d"), (None, None, "e"), (2, bad, "f"), (2, bad, "g"), (3, "", "h"), (4, None, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, "ten eleven"), (4, "twelve thirteen")], "item_id long, text string")
    for block_chars in (decontaminate.BLOCK_CHARS, 20):
        got = decontaminate.drop_contaminated(docs, bench, block_chars=block_chars)
        assert got.columns == docs.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in rows if r[1] != bad), block_chars


def plain_guess_cost(value, blocks=True):
    """Every segmentation's least cost: each length of each form at each place; a brute-force span is a segment too."""
    import math

    low, plain, n = value.lower(), value.lower().translate(secrets._LEET), len(value)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        brute = 0.0
        for j in range(i + 1, n + 1):
            brute += secrets._space(value[j - 1])
            costs = [brute]
            costs += [secrets.COMMON.cost[f[i:j]] + x + 0.5 * (value[i:j] != low[i:j]) for f, x in ((low, 0), (plain, 0.5)) if j - i > 2 and f[i:j] in secrets.COMMON.cost]
            if j - i > 2:
                pairs = list(zip(low[i:j], low[i + 1 : j]))
                costs += [1.5 + math.log10(j - i)] * (all(a == b for a, b in pairs) or all(ord(b) - ord(a) == 1 for a, b in pairs))
                costs += [2.0 + math.log10(j - i)] * (j - i > 3 and all(secrets._adjacent(a, b) for a, b in pairs))
            costs += [4.6 if j - i > 4 else 2.1] * bool(secrets._DATE.fullmatch(value, i, j))
            for size in range(2, 9) if blocks else ():
                times = (j - i) // size
                if times > 1 and value[i:j] == value[i : i + size] * times:
                    costs.append(plain_guess_cost(value[i : i + size], False) + math.log10(times))
            best[j] = min(best[j], best[i] + min(costs) + (math.log10(2) if i else 0))
    return best[-1]


def test_guess_cost_is_the_least():
    import random

    pick = random.Random(5)
    parts = ["password", "Dragon", "p@55w0rd", "aaaaaaaa", "a" * 90, "1" * 70, "abcdefghij", "12345678", "qwertyuiop", "asdfg", "1999", "2001-12-31", "19991231", "1.2.2003", "123456", "x", "K#", "secret", "7", "abcabcabc", "xY7xY7"]
    for _ in range(300):
        value = "".join(p[pick.randrange(2) * pick.randrange(len(p)) :] for p in pick.choices(parts, k=pick.randint(1, 4)))
        assert secrets.guess_cost(value) == pytest.approx(plain_guess_cost(value)), value
        cost = secrets.guess_cost(value, secrets.MIN_GUESSES)
        assert cost == pytest.approx(plain_guess_cost(value)) if plain_guess_cost(value) < secrets.MIN_GUESSES else cost == float("inf")
    assert secrets.guess_cost("1" + "z" * 400) < 6 and secrets.scan_text("pwd: 1" + "z" * 400)[1] == []
    # the repeat leaves its last letter, the date its last digits to the word behind
    for value, parts in (("ddddddragon", ("ddddd", "dragon")), ("20011123456", ("2001", "1", "123456"))):
        assert secrets.guess_cost(value) <= sum(map(secrets.guess_cost, parts)) + 0.31 * (len(parts) - 1)


def test_long_values_are_costed_quickly():
    text = "pwd: " + "k#v!xq$z%wp" * 500_000 + " login: 1" + "z" * 20_000
    assert [k for _, k, _ in secrets.scan_text(text)[1]] == ["guess"]


def test_rare_languages_are_learned(spark):
    rows = [(i, "the quiet river runs by the old mill", "en") for i in range(3000)] + [(5000 + i, "hiljainen joki virtaa vanhan myllyn ohi", "fi") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, sample=60)
    assert model[0] == ["en", "fi"]
    assert {(r.doc_id >= 5000, r.lang_pred) for r in language.predict(docs, model).collect()} == {(False, "en"), (True, "fi")}
    assert language._most([3, 9000], 6000) == 5997 and language._most([5, 9], 60) == 9 and language._most([10**6] * 100, 6000) == language.LEAST


def test_pipeline_against_a_plain_one(spark, tmp_path):
    import random

    import corpus_pipeline
    import pyarrow as pa
    from tokenizers import Tokenizer

    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(pick.choices(vocabulary, k=n))
    items = [(f"b{i}", prose(30)) for i in range(5)]
    rows = [(i, prose(60)) for i in range(60)]
    rows += [(100 + i, prose(20) + " idiot " + prose(20)) for i in range(80)] + [(600 + i, prose(50)) for i in range(100)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(8)] + [(210, rows[9][1].upper()), (211, rows[10][1]), (10, rows[10][1])]
    rows += [(300 + i, f"{prose(20)} {t} {prose(20)}") for i, (_, t) in enumerate(items)] + [(310, prose(20) + " " + items[0][1][:20])]
    secret = "k#v!xq$z%wp"
    rows += [(400 + i, f"{prose(30)} password: {secret} {prose(9)} token=abcdef{i}!{secret}") for i in range(5)]
    rows += [(None, prose(40)), (None, items[1][1]), (None, f"{prose(30)} secret = '{secret}'"), (500, None), (501, ""), (502, "  ")]
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, int(100 <= d < 180)) for d, _ in rows if d is not None and (d < 180 or d >= 600)], "doc_id long, toxic int").distinct().write.parquet(f"{tmp_path}/labels.parquet")

    taken = {}
    frame, plain = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{tmp_path}/{name}"
        stage(spark, frame, str(tmp_path)).write.parquet(out)
        frame = spark.read.parquet(out)
        got = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        if name == "toxicity":  # each text by itself, by a network learned apart
            model = toxicity.fit(toxicity.training_rows(docs), spark.read.parquet(f"{tmp_path}/labels.parquet"))
            want = [r for r in plain if toxicity._text_scores(model, pa.array([r[1]], pa.string()))[0] < toxicity.THRESHOLD]
            assert sum("idiot" in (t or "") for _, t in want) <= 8 and sum("idiot" not in (t or "") for _, t in want) >= 0.95 * (len(rows) - 80)
        elif name == "ngram_jaccard":
            want = plain_copies_dropped(plain)
        elif name == "decontamination":
            want = [r for r in plain if not plain_contaminated(r[1], [t for _, t in items])]
        else:
            assert not any(secret in (t or "") or "abcdef" in (t or "") for _, t in got)
            want = [(d, t and re.sub(r"password: \S+|token=\S+|(?<=secret = ')[^']+", lambda m: "password: [secret]" if m[0][0] == "p" else "[secret]", t)) for d, t in plain]
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in frame.collect())
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
        taken[name], plain = (len(plain), len(got)), got
    assert all(a > b for n, (a, b) in taken.items() if n != "secrets") and len(set(taken["secrets"])) == 1
    library = Tokenizer.from_file(bpe.default_path())
    ends = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is not null").collect()}
    assert sorted(ends) == sorted(d for d, _ in plain if d is not None)
    assert all(ends[d].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids) and ends[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for d, t in plain if d is not None)


def plain_copies_dropped(rows):
    """Of the rows of linked sets of five words that of the least id; rows without an id stay."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0] is not None:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for r, (d, t) in zip(root, rows):
        if d is not None:
            least[r] = min(least.get(r, (d, t)), (d, t), key=lambda x: x[0])
    return [*least.values(), *(r for r in rows if r[0] is None)]


def plain_contaminated(text, items):
    w, hit = WORD.findall(lower(text)), set()
    for t in items:
        v = WORD.findall(lower(t))
        for size in {min(13, len(v))}:
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
            hit |= {k for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows for k in range(i, i + size)}
    return bool(hit) and 20 * len(hit) >= len(w)
