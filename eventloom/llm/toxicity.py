"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word's input is its row in a table of the words that the training sample repeats (row 0, all zeros at the start, for
others) plus the mean of the rows of its hashed character trigrams. Two recurrent passes, one in each direction, read a
window of 64 words; attention pools their states into one logit. A text is scored by its highest window, over all windows
that start every 48 words, so that each word is read with context on both sides and no text is cut.

Training runs in numpy on the driver, on a bounded sample: at most ``SAMPLE`` labelled texts of at most ``SAMPLE_CHARS``
characters, half of them toxic where there are as many. The first passes give every window its text's label; later passes
train on the highest window of each text, as scoring does. The seed is fixed, the sample is chosen by hash.

Null and empty texts have no words and are scored as a window without words. Labels of null, ids of null and texts of null
aren't learned from; a doc_id labelled twice takes its higher label, one with several texts its least. With no label to learn from every score is 0.
Repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import crc_fold, map_batches, table
from eventloom.llm.decontaminate import words_of

WINDOW, STRIDE, DIM, HIDDEN, TRIGRAMS, VOCABULARY = 64, 48, 12, 8, 1 << 14, 20_000
SAMPLE, SAMPLE_CHARS, PASSES, BATCH, RATE, THRESHOLD = 1600, 10_000, 8, 64, 0.01, 0.3
SCORED_AT_ONCE = 1024  # windows
STEPS = 200  # least number of training steps; small samples are passed over more often


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _squash(x: np.ndarray) -> None:
    """The logistic function, in place; float32's exp is faster than its tanh."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def windows_of(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word among all texts' words, length) of every window."""
    owner, first, size, at = [], [], [], 0
    for i, n in enumerate(counts):
        for a in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE):
            owner.append(i)
            first.append(at + a)
            size.append(min(WINDOW, n - a))
        at += n
    return np.array(owner, np.int64), np.array(first, np.int64), np.array(size, np.int64)


def _matrix(ids: np.ndarray, first: np.ndarray, size: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ids and mask of windows, windows x steps."""
    step = np.arange(max(1, size.max(initial=0)))
    mask = step < size[:, None]
    at = np.where(mask, first[:, None] + step, 0)
    return np.where(mask, ids[at] if len(ids) else pad, pad), mask


class Words:
    """Inputs of distinct words: row in the vocabulary and hashed trigrams."""

    def __init__(self, words: list[bytes], vocabulary: dict[bytes, int]):
        words = [*words, b""]  # the last stands for padding
        self.rows = np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words))
        raw = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        grams = np.zeros(len(raw), np.uint64)
        grams[2:] = (raw[2:] * np.uint64(65536) + raw[1:-1] * np.uint64(256) + raw[:-2]) * np.uint64(0x9E3779B97F4A7C15)
        owner = np.repeat(np.arange(len(words)), sizes)
        starts = np.cumsum(sizes) - sizes
        whole = np.arange(len(raw)) - starts[owner] >= 2  # within one word
        self.grams, self.owner = (grams[whole] >> np.uint64(50)).astype(np.int64), owner[whole]
        self.count = np.maximum(np.bincount(self.owner, minlength=len(words)), 1).astype(np.float32)

    def inputs(self, p: dict) -> np.ndarray:
        total = np.zeros((len(self.rows), DIM), np.float32)
        if len(self.owner):
            at = np.flatnonzero(np.r_[True, np.diff(self.owner) > 0])
            total[self.owner[at]] = np.add.reduceat(p["chars"][self.grams], at)
        return p["words"][self.rows] + total / self.count[:, None]


def new_model(vocabulary: int, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    p = {"words": np.zeros((vocabulary + 1, DIM), np.float32), "chars": rng.normal(0, 0.3, (TRIGRAMS, DIM)).astype(np.float32)}
    for d in "fb":
        p |= {f"W{d}": draw(DIM, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 2 * HIDDEN), f"N{d}": draw(HIDDEN, HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"A": draw(2 * HIDDEN, HIDDEN), "a": draw(HIDDEN, 1), "o": draw(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}


def forward(p: dict, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows; x: inputs of distinct words. With ``keep`` also what backward needs."""
    n, steps = ids.shape
    states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    kept: dict = {}
    m, at = mask.T[:, :, None].astype(np.float32), np.ascontiguousarray(ids.T)
    for k, d in enumerate("fb"):
        gates = x @ p[f"W{d}"] + p[f"b{d}"]
        h = np.zeros((n, HIDDEN), np.float32)
        u, v, trace = p[f"U{d}"], p[f"N{d}"], []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gates.take(at[t], 0)
            zr = h @ u
            zr += g[:, : 2 * HIDDEN]
            _squash(zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            rh = r * h
            c = rh @ v
            c += g[:, 2 * HIDDEN :]
            c += c
            _squash(c)
            c += c
            c -= 1
            new = (h + z * (c - h)) * m[t]
            if keep:
                trace.append((t, h, z, r, rh, c))
            h = new
            states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        kept[d] = trace
    q = np.tanh(states @ p["A"])
    e = (q @ p["a"])[:, :, 0]
    e = np.where(mask.T, e, -30.0)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = (w[:, :, None] * states).sum(0)
    logits = (pooled @ p["o"])[:, 0] + p["c"][0]
    return (logits, (states, q, w, pooled, kept, m)) if keep else logits


def backward(p: dict, words: Words, x: np.ndarray, ids: np.ndarray, kept, dlogits: np.ndarray) -> dict:
    """Gradients of the parameters."""
    states, q, w, pooled, trace, m = kept
    d = dlogits[:, None].astype(np.float32)
    g = {"o": pooled.T @ d, "c": d.sum(0)}
    dpool = d @ p["o"].T
    dw = (states * dpool).sum(2)
    de = w * (dw - (w * dw).sum(0))
    dq = de[:, :, None] * p["a"][:, 0]
    g["a"] = (q * de[:, :, None]).sum((0, 1))[:, None]
    dq = dq * (1 - q * q)
    g["A"] = states.reshape(-1, 2 * HIDDEN).T @ dq.reshape(-1, HIDDEN)
    dstates = w[:, :, None] * dpool + dq @ p["A"].T
    dx = np.zeros_like(x)
    for k, way in enumerate("fb"):
        u, v, gates = p[f"U{way}"], p[f"N{way}"], np.zeros((len(x), 3 * HIDDEN), np.float32)
        gu, gv, carry = np.zeros_like(u), np.zeros_like(v), np.zeros((len(ids), HIDDEN), np.float32)
        for t, h, z, r, rh, c in reversed(trace[way]):
            dh = (carry + dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN]) * m[t]
            dc = dh * z * (1 - c * c)
            drh = dc @ v.T
            dz, dr = dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            gv += rh.T @ dc
            gu += h.T @ dzr
            carry = dh * (1 - z) + drh * r + dzr @ u.T
            np.add.at(gates, ids[:, t], np.concatenate([dzr, dc], 1))
        g |= {f"U{way}": gu, f"N{way}": gv, f"W{way}": x.T @ gates, f"b{way}": gates.sum(0)}
        dx += gates @ p[f"W{way}"].T
    g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(g["words"], words.rows, dx)
    g["words"][0] = 0  # words out of the vocabulary are known by their characters alone
    np.add.at(g["chars"], words.grams, (dx / words.count[:, None])[words.owner])
    return g


def _scores(model, texts: list[list[bytes]]) -> np.ndarray:
    """Logits of all windows of tokenized texts, with their owners."""
    vocabulary, p = model
    ids = _Ids()
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
    words = Words(list(ids), vocabulary)
    x, pad = words.inputs(p), len(ids)
    owner, first, size = windows_of([len(t) for t in texts])
    out = np.empty(len(owner), np.float32)
    for a in range(0, len(owner), SCORED_AT_ONCE):
        b = slice(a, a + SCORED_AT_ONCE)
        out[b] = forward(p, x, *_matrix(flat, first[b], size[b], pad))
    return owner, out, flat, first, size, list(ids)


def train(texts: list[str], labels: list[int], passes: int = PASSES, seed: int = 7):
    """(vocabulary, parameters) learned from whole texts."""
    tokens = [words_of(t) for t in texts]
    seen: dict[bytes, int] = {}
    for t in tokens:
        for w in set(t):
            seen[w] = seen.get(w, 0) + 1
    known = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY]
    vocabulary, y = {w: i + 1 for i, w in enumerate(known)}, np.array(labels, np.float32)
    p, rng = new_model(len(known), seed), np.random.default_rng(seed)
    first_moment, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    passes = max(passes, min(100, -(-STEPS * BATCH // max(1, len(tokens)))))
    for turn in range(passes):
        owner, logits, flat, first, size, names = _scores((vocabulary, p), tokens)
        if turn < 2:
            chosen = rng.permutation(len(owner))[: 3 * len(tokens)]
        else:
            order = np.lexsort((-logits, owner))
            chosen = rng.permutation(order[np.r_[True, np.diff(owner[order]) > 0]])
        for a in range(0, len(chosen), BATCH):
            c = chosen[a : a + BATCH]
            ids, mask = _matrix(flat, first[c], size[c], len(names))
            distinct, local = np.unique(ids, return_inverse=True)
            words = Words([names[i] if i < len(names) else b"" for i in distinct], vocabulary)
            x = words.inputs(p)
            got, kept = forward(p, x, local.reshape(ids.shape), mask, keep=True)
            grads = backward(p, words, x, local.reshape(ids.shape), kept, (_sigmoid(got) - y[owner[c]]) / len(c))
            step += 1
            for k, g in grads.items():
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] = (p[k] - RATE * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return vocabulary, p


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS):
    """The model learned from (doc_id, text) and (doc_id, toxic); None without a label."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= sample_chars))
    # the ids are chosen without their texts; the texts of at most ``sample`` ids are read afterwards
    known = marks.join(rows.select("doc_id"), "doc_id", "left_semi").withColumn("spot", F.xxhash64("doc_id"))
    chosen = [r for mark in (1, 0) for r in known.where(F.col("toxic") == mark).orderBy("spot", "doc_id").limit(sample // 2).collect()]
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame([(r.doc_id,) for r in chosen], f"doc_id {dict(docs.dtypes)['doc_id']}")
    texts = dict(rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    taken = [r for r in chosen if r.doc_id in texts]
    return train([texts[r.doc_id] for r in taken], [r.toxic for r in taken]) if taken else None


def _text_scores(model, column: pa.Array) -> np.ndarray:
    """Score of every text of a batch; runs of texts are scored together, so that memory is bounded by a batch."""
    if not model:
        return np.zeros(len(column))
    best = np.full(len(column), -np.inf)
    texts, size, at = [], 0, []

    def close() -> None:
        owner, logits, *_ = _scores(model, texts)
        np.maximum.at(best, np.array(at)[owner], logits)
        texts.clear()
        at.clear()

    for i, text in enumerate(column):
        texts.append(words_of(text.as_py()))
        at.append(i)
        size += len(texts[-1])
        if size > 64 * SCORED_AT_ONCE:
            close()
            size = 0
    if texts:
        close()
    return _sigmoid(best)


def score(docs: DataFrame, model, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``extra`` columns, score and predicted of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    types, width = dict(docs.dtypes), 1 + len(extra)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = _text_scores(sent.value, batch.column(width))
        return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", *extra, "score", "predicted"])

    schema = ", ".join([f"doc_id {types['doc_id']}", *(f"{c} {types[c]}" for c in extra), "score double, predicted int"])
    return map_batches(docs.select("doc_id", *extra, "text"), run, schema)


def drop_toxic(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    return map_batches(docs, lambda b: b.filter(pa.array(_text_scores(sent.value, b.column(at)) < THRESHOLD)), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that labels may be learned from."""
    return docs.where(F.coalesce(crc_fold("doc_id", 4) != 2, F.lit(False)))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    return score(docs.select("doc_id", "text", held.alias("held_out")), fit(training_rows(docs), table(spark, sf_dir, "labels")), ("held_out",))
