"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of the benchmark items (an item of fewer words is one window). A block
of two words indexes the shift table, so that most places of a document are skipped; where the shift is 0, the block's
bucket names the windows that end there, and direct comparison confirms them. Short windows have tables of their own.

Benchmark texts are broadcast in blocks of about ``BLOCK_CHARS`` characters. A block is filled text by text on the driver, which
holds one block at a time; a longer text is cut into pieces that overlap by a window less a word, so that no window is lost. A
benchmark of several blocks is searched block by block, and the hits of equal (doc_id, text) are united. The result is the same
whatever the number of blocks. Null texts have no words; items with a null id or no words are left out; repeated rows
stay; empty tables give empty results or no hits. Only doc_id/text and item_id/text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import durable, map_batches, table

WINDOW = 13
BLOCK_CHARS = 1 << 20  # of benchmark texts; the tables made of them take about a hundred times as many bytes
#: Bytes that part words become spaces; A-Z are lower-cased.
_TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<int>, h long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int32())), ("h", pa.int64())])


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class WuManber:
    """Search of word windows of one length."""

    def __init__(self, size: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.size, self.patterns, self.block = size, patterns, min(2, size)
        self.shift: dict = {}
        for p in patterns:
            for end in range(self.block, size + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, size), size - end)
        self.buckets: dict = {}
        for p in patterns:
            self.buckets.setdefault(p[size - self.block :], set()).add(p)

    def search(self, words: list[bytes]):
        """(start, items) of every occurrence."""
        size, block, skip = self.size, self.block, self.size - self.block + 1
        shift, end, n = self.shift, self.size, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            by = shift.get(key, skip)
            if by:
                end += by
                continue
            found = tuple(words[end - size : end])
            if found in self.buckets[key]:
                yield end - size, self.patterns[found]
            end += 1


def compile_items(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    by: dict[int, dict] = {}
    known: dict[bytes, bytes] = {}  # equal words are one object
    for item, text in items:
        w = [known.setdefault(x, x) for x in words_of(text)]
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            by.setdefault(size, {}).setdefault(tuple(w[i : i + size]), set()).add(item)
    return [WuManber(size, p) for size, p in sorted(by.items())]


def _row(doc_id, n_words: int, spans: list[tuple[int, int]], items: set[str], h: int) -> dict:
    hit, last = 0, 0
    for a, b in sorted(spans):
        hit += max(0, b - max(a, last))
        last = max(last, b)
    names = sorted(items)
    merged: list[int] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1]:
            merged[-1] = max(merged[-1], b)
        else:
            merged += [a, b]
    return {"doc_id": doc_id, "n_words": n_words, "n_hit": hit, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "contaminated": hit > 0 and 20 * hit >= n_words, "items": names, "spans": merged, "h": h}


def _searcher(spark, items: list[tuple[str, str]], window: int):
    """A function of a document's words to its hit spans and items; each task compiles the tables once."""
    sent, tables = spark.sparkContext.broadcast(items), []

    def search(words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        if not tables:
            tables.append(compile_items(sent.value, window))
        spans, found = [], set()
        for t in tables[0]:
            for at, names in t.search(words):
                spans.append((at, at + t.size))
                found |= names
        return spans, found

    return search


def _scan(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    search = _searcher(docs.sparkSession, items, window)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            w = words_of(text.as_py())
            out.append(_row(doc_id, len(w), *search(w), h))
        return pa.RecordBatch.from_pylist(out, _ARROW)

    return map_batches(docs, run, SCHEMA)


def _pieces(text: str, window: int, most: int) -> list[str]:
    """Parts of a text of about ``most`` characters that hold every window of its words."""
    if len(text) <= most:
        return [text]
    words, out, first, size = [w.decode() for w in words_of(text)], [], 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= most and i + 1 - first >= 2 * window:
            out.append(" ".join(words[first : i + 1]))
            first = i + 2 - window
            size = sum(len(x) + 1 for x in words[first : i + 1])
    return [*out, " ".join(words[first:])] if not out or len(words) - first >= window else out


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """Blocks of (item_id, text), one at a time; rows that repeat come once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    block, size = [], 0
    for item, text in items.toLocalIterator():
        for piece in _pieces(text, window, block_chars):
            if block and size + len(piece) > block_chars:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    yield block


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    blocks = _blocks(benchmark, window, block_chars)
    block, more = next(blocks), next(blocks, None)
    if more is not None:
        bad = _united(_keyed(docs), chain([block, more], blocks), window).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"))
        return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left_anti")
    search, at = _searcher(docs.sparkSession, block, window), docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for text in batch.column(at):
            w = words_of(text.as_py())
            keep.append(not _row(None, len(w), *search(w), None)["contaminated"])
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document: see SCHEMA. ``spans`` holds start and end of the hit runs, in words."""
    docs, blocks = _keyed(docs), _blocks(benchmark, window, block_chars)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _scan(docs, block, window).drop("h")
    merged = _united(docs, chain([block, more], blocks), window)
    return docs.select(F.col("doc_id").alias("d"), F.col("h").alias("g")).join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).drop("d", "g", "h")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))


def _united(docs: DataFrame, blocks: Iterable[list[tuple[str, str]]], window: int) -> DataFrame:
    """One row of SCHEMA for each doc_id and text of ``docs``."""
    parts = None
    for block in blocks:  # texts are read, never shuffled; a checkpoint now, so that the driver lets go of the block
        found = durable(_scan(docs, block, window).where("n_hit > 0").dropDuplicates(["doc_id", "h"]))
        parts = found if parts is None else parts.unionByName(found)
    hits = parts.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
    counted = map_batches(docs, lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words_of(t.as_py())) for t in b.column(1)], pa.int64()), b.column(2)], names=["doc_id", "n_words", "h"]), "doc_id long, n_words long, h long").distinct()
    hits = hits.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "s", "i")
    united = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select("doc_id", "n_words", "h", F.coalesce("s", F.array().cast("array<int>")).alias("s"), F.coalesce("i", F.array().cast("array<string>")).alias("i"))

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_row(d, n, list(zip(s[::2], s[1::2])), set(i), h) for d, n, h, s, i in zip(*(c.to_pylist() for c in batch.columns))]
        return pa.RecordBatch.from_pylist(out, _ARROW)

    return map_batches(united, merge, SCHEMA)


def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


#: Brute force: every window of every item against every place of every document.
OP10_SQL = r"""
WITH words(kind, id, name, w) AS (
  SELECT kind, id, name, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')
  FROM (SELECT 'd' AS kind, row_number() OVER () AS id, doc_id::VARCHAR AS name, text FROM documents
        UNION ALL SELECT 'b', row_number() OVER (), item_id::VARCHAR, text FROM benchmark WHERE item_id IS NOT NULL)
), items AS (SELECT name AS item, w, least(13, len(w)) AS size FROM words WHERE kind = 'b' AND len(w) > 0
), patterns AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS p FROM items, unnest(range(1, len(w) - size + 2)) r(i)
), sizes AS (SELECT DISTINCT size FROM patterns
), places AS (SELECT id, size, i - 1 AS s, array_to_string(w[i : i + size - 1], ' ') AS p FROM words, sizes, unnest(range(1, len(w) - size + 2)) r(i) WHERE kind = 'd' AND len(w) >= size
), found AS (SELECT id, s, size, item FROM places JOIN patterns USING (size, p)
), hit AS (SELECT id, count(DISTINCT x) AS n_hit FROM found, unnest(range(s, s + size)) u(x) GROUP BY 1
), named AS (SELECT id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM found GROUP BY 1)
SELECT doc_id, n_words, n_hit, n_items, sha256(names) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated
FROM (SELECT name::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(names, '') AS names
      FROM words LEFT JOIN hit USING (id) LEFT JOIN named USING (id) WHERE kind = 'd')
"""
