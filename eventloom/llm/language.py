"""Language identification by multinomial naive Bayes over hashed character n-grams.

Learning: n-grams of 1 to 3 lower-cased characters (letters; all else is a word border) are hashed into ``BUCKETS`` buckets
and counted by language on the executors. Of each language at most about as many rows are learned, chosen by the hash of
their ids, as make ``SAMPLE`` rows of all, and no fewer than ``LEAST``; a language with fewer rows is learned from them all.
Counts are summed by Spark; the driver gets at most languages * BUCKETS sums, makes a float32 log-probability matrix of
them (smoothed, with a uniform prior) and broadcasts it. Scoring: a batch is a sparse document-by-bucket matrix in
coordinate form that meets the matrix by a gather and segment sums.

Null text and text without a letter: ``und`` with score 0. Without any learned language every row is ``und``. Ties go to
the language that sorts first. Null ids are kept and take no part in learning. Repeated rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import crc_fold, map_batches, table

BUCKETS, SAMPLE, LEAST, ALPHA = 1 << 15, 6000, 200, 0.5
CHUNK = 1 << 20  # characters that are hashed at once
_FOLDS, _HELD = 3, 1
_PAGE, _UNKNOWN = 256, 0xFFFFFFFF  # code points that are looked up together, and the mark of those that aren't yet


class _Letters:
    """Lower-case letter of code points, 0 where one is no letter; filled page by page as texts need it."""

    def __init__(self):
        self.low = np.full(0x110000, _UNKNOWN, np.uint32)

    def of(self, points: np.ndarray) -> np.ndarray:
        got = self.low[points]
        missing = got == _UNKNOWN
        if missing.any():
            for page in np.unique(points[missing] // _PAGE).tolist():
                for c in range(page * _PAGE, (page + 1) * _PAGE):
                    s = chr(c)
                    self.low[c] = (ord(low) if len(low := s.lower()) == 1 else c) if s.isalpha() else 0
            got = self.low[points]
        return got


_LETTERS = _Letters()


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, places) of the n-grams that hold a letter at their end."""
    c = codes.astype(np.uint64)
    p, q = np.roll(c, 1), np.roll(c, 2)
    p[:1], q[:2] = 0, 0
    q[p == 0] = 0  # nothing is seen across a border
    at = np.flatnonzero((c > 0) | (p > 0))  # with the n-grams that end a word
    c, p, q = c[at], p[at], q[at]
    mixed = np.concatenate([c * np.uint64(0x9E3779B97F4A7C15), (p * np.uint64(1 << 21) + c) * np.uint64(0xC2B2AE3D27D4EB4F), ((q * np.uint64(1 << 21) + p) * np.uint64(1 << 21) + c) * np.uint64(0x165667B19E3779F9)])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - 15)).astype(np.int32), np.concatenate([at, at, at])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, each followed by a border, and the text's place of each character."""
    joined = "\0".join(texts) + "\0"
    codes = _LETTERS.of(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    return codes, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def _groups(texts: list[str | None]):
    """Runs of texts of about CHUNK characters; a longer text is a run of its own."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "")
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def _most(sizes: list[int], sample: int) -> float:
    """Rows of a language at most, so that all languages have ``sample`` together where they hold as many."""
    rest = float(sample)
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) >= rest:
            return max(rest / (len(sizes) - k), min(LEAST, sample))
        rest -= n
    return float(max(sizes))


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix buckets x languages) from doc_id, text and lang."""
    rows = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    most = _most(list(sizes.values()), sample)
    limits = docs.sparkSession.createDataFrame([(lang, int(min(1.0, most / n) * (1 << 20)) + 1) for lang, n in sizes.items()], "lang string, upto long")
    chosen = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("upto")).select("doc_id", "text", "lang")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            got = by.setdefault(lang, np.zeros(BUCKETS, np.int64))
            got += np.bincount(_grams(_codes([text])[0])[0], minlength=BUCKETS)
        langs, buckets, sums = [], [], []
        for lang, got in by.items():
            at = np.flatnonzero(got)
            langs += [lang] * len(at)
            buckets.append(at)
            sums.append(got[at])
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(buckets), pa.int64()), pa.array(np.concatenate(sums), pa.int64())], names=["lang", "bucket", "n"])

    sums = map_batches(chosen, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.full((BUCKETS, len(langs)), ALPHA)
    np.add.at(counts, (sums["bucket"].to_numpy(), np.searchsorted(np.array(langs, dtype=object), sums["lang"].to_numpy())), sums["n"].to_numpy())
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``extra`` columns, lang_pred and score (the posterior probability of lang_pred)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)
    width = 1 + len(extra)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, logp = sent.value
        texts = batch.column(width).to_pylist()
        best, sure = ["und"] * len(texts), [0.0] * len(texts)
        for run in _groups(texts) if langs else ():
            codes, owner = _codes([texts[i] or "" for i in run])
            buckets, at = _grams(codes)
            doc = owner[at]
            total = np.stack([np.bincount(doc, logp[:, k][buckets], len(run)) for k in range(len(langs))], 1)
            lettered = np.bincount(owner, codes > 0, len(run)) > 0
            top = total.argmax(1)
            post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for j in np.flatnonzero(lettered):
                best[run[j]], sure[run[j]] = langs[top[j]], float(post[j])
        return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", *extra, "lang_pred", "score"])

    schema = ", ".join([f"doc_id {types['doc_id']}", *(f"{c} {types[c]}" for c in extra), "lang_pred string", "score double"])
    return map_batches(docs.select("doc_id", *extra, "text"), score, schema)


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_fold("doc_id", _FOLDS) == _HELD, F.lit(False))
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model, ("held_out",))
