"""N-gram Jaccard join by vertical partitioning.

A document's set holds 64-bit hashes of its distinct 5-word shingles. Documents with equal sets form a class; the join works
on classes. All shingles have one global order: the frequent ones (found by counting over all documents) last, else by
hash. Two sets with a Jaccard of at least 0.75 share a shingle within their prefixes, so only prefixes are posted.

Candidates: in a bucket (one shingle's postings) each class is first paired with its neighbour in size and with the bucket's
hub, the class with the largest share of frequent shingles (of near copies, the one closest to their common text). The
``FIRST`` nearest of these are tried for each class. Pairs are verified by vertical partitioning: the order is cut into ``FRAGMENTS``
ranges, the overlap of a pair is counted in each range by itself, and the partial counts are summed. Linked classes are
joined into components; then all classes that share a bucket across components, and pass the bounds, are verified too. Every
link between different texts is thus either verified or lies within one component already; nothing is capped. The postings of
a hot shingle are dealt to several tasks by a salt for the first step, which only chooses an order; for the second a bucket is
cut into blocks of about ``BUCKET`` classes, and every two blocks meet in a task of their own.

The bounds are exact: sizes, positions, and a parity sketch. Its bit i tells if a set has an odd number of shingles that
hash to i, so two sets differ in at least as many shingles as their sketches differ in bits; linked sets differ in at most a
seventh of their sizes' sum. The short sketch rejects most pairs of up to some 600 shingles; larger sets also have a wide
one, of as many bits as shingles or up to twice that, which is compared before the texts are read again.

Null and empty texts have an empty set and no link: their component is their own id. Rows with one doc_id and several texts
are one node. Null ids are kept; they never name a component. Repeated rows stay; an empty table gives an empty result; only
doc_id and text are read. Chance equality of 64-bit hashes (about 1e-19 a pair) is accepted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import Scratch, durable, map_stream, release, table

SHINGLE, FRAGMENTS, SKETCH = 5, 8, 8  # SKETCH: 64-bit words of a parity sketch
#: Neighbours tried for each class before all the rest is; a choice of order alone.
FIRST = 3
#: The order of shingles alone depends on these two, never the result: shingles seen this often are late, and so many of them.
FREQUENT, MOST_FREQUENT = 6, 1_000_000
COUNTED_AT_ONCE = 2_000_000  # shingles of distinct sets in which a task looks for repeated ones at a time
BUCKET = 4096  # postings of a shingle that one task gets together; larger buckets are dealt to several
SIEVE_BITS = 1 << 24  # of the filter that spares reading documents that aren't in a pair
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BITS = [f"bits{i}" for i in range(SKETCH)]
_U = np.uint64
_P, _P_INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = [_U(k) for k in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased."""
    b = np.frombuffer(b" " + text.encode().translate(_LOWER) + b" ", np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power = np.full(len(b), _P)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + _U(1)) * power, out=total[1:])
    back = np.full(len(b), _P_INVERSE)
    back[0] = 1
    return _mix((total[end] - total[start]) * np.multiply.accumulate(back)[start] + (end - start).astype(np.uint64) * _MIX[0])


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    total = np.full(n, _U(size * 0xA24BAED4963EE407 % (1 << 64)))
    for i in range(size):
        total += w[i : i + n] * _MIX[i]
    return np.unique(_mix(total))


def key_of(s: np.ndarray) -> int:
    """A set's class key, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([np.add.reduce(_mix(s + _MIX[0])) + _U(len(s)) * _MIX[1] ^ np.bitwise_xor.reduce(s * _MIX[2])]))[0].astype(np.int64))


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as ``SKETCH`` signed 64-bit numbers."""
    odd = np.bincount((s & _U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch_of(s: np.ndarray) -> np.ndarray | None:
    """The parity sketch of a large set, in a power of two of 64-bit numbers; its halves' exclusive or is that of half the width."""
    if len(s) <= 64 * SKETCH:
        return None
    width = 1 << (len(s) - 1).bit_length()
    odd = np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, sketches) of every row, and rows without these that hold shingles seen repeatedly with their counts."""

    kind = pa.list_(pa.int64())
    names = ["doc_id", "n", "key", *_BITS, "wide", "common", "counts"]

    def repeated(own: dict[int, np.ndarray], id_type) -> pa.RecordBatch:
        common, count = np.unique(np.concatenate(list(own.values())), return_counts=True)
        keep = count > 1
        row = [pa.nulls(1, id_type), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([0], pa.int64()) for _ in _BITS), pa.nulls(1, kind)]
        return pa.RecordBatch.from_arrays([*row, pa.array([common[keep].astype(np.int64)], kind), pa.array([count[keep]], kind)], names=names)

    def run(batches):
        own, held, id_type = {}, 0, None  # the sets whose shingles are counted together
        for b in batches:
            sizes, keys, sketches, wide, id_type = [], [], [], [], b.schema.field(0).type
            for t in b.column(1):
                s = shingles(t.as_py())
                sizes.append(len(s))
                keys.append(key_of(s) if len(s) else None)
                sketches.append(sketch_of(s))
                wide.append(wide_sketch_of(s))
                if len(s) and keys[-1] not in own:
                    own[keys[-1]] = s
                    held += len(s)
                if held >= COUNTED_AT_ONCE:
                    yield repeated(own, id_type)
                    own, held = {}, 0
            bits = np.array(sketches)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *map(pa.array, bits.T.copy()), pa.array(wide, kind), pa.nulls(len(sizes), kind), pa.nulls(len(sizes), kind)], names=names)
        if own:
            yield repeated(own, id_type)

    return map_stream(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, key long, {', '.join(f'{c} long' for c in _BITS)}, wide array<long>, common array<long>, counts array<long>")


def _postings(docs: DataFrame, late: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(shingle, salt, key, n, at, hub) of the prefixes, hub: late shingles in a thousand; copies of a text are posted once a task.

    The salt deals the classes of a ``hot`` shingle to so many ``parts``, from 1 on; it is 0 for all others.
    """
    sent = docs.sparkSession.sparkContext.broadcast((late, hot, parts))

    def run(batches):
        (late, hot, into), done = sent.value, set()
        for b in batches:
            parts = []
            for t in b.column(1):
                s = shingles(t.as_py())
                if not len(s) or (key := key_of(s)) in done:
                    continue
                done.add(key)
                hub = 0
                if len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    is_late = late[at] == s
                    hub = int(1000 * is_late.sum() // len(s))
                    s = np.concatenate([s[~is_late], s[is_late]])
                p = prefix_size(len(s))
                salt = np.zeros(p, np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s[:p]), len(hot) - 1)
                    salt = np.where(hot[at] == s[:p], 1 + key % into[at], 0).astype(np.int32)
                parts.append((s[:p], salt, key, len(s), hub, p))
            if len(done) > 1_000_000:
                done.clear()
            if parts:
                posted, salts, keys, sizes, hubs, size = zip(*parts)
                spread = lambda v, kind: pa.array(np.repeat(np.array(v, kind), size))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(posted).astype(np.int64)), pa.array(np.concatenate(salts)), spread(keys, np.int64), spread(sizes, np.int32), pa.array(np.concatenate([np.arange(p, dtype=np.int32) for p in size])), spread(hubs, np.int16)], names=["shingle", "salt", "key", "n", "at", "hub"])

    return map_stream(docs, run, "shingle long, salt int, key long, n int, at int, hub short")


def _segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, fragment, part) of the sets of ``wanted`` documents (doc_id, key), and of few others that the sieve lets pass."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS))
    words = wanted.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toPandas()  # at most SIEVE_BITS / 64 rows
    sieve = np.zeros(SIEVE_BITS // 64, np.int64)
    sieve[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(sieve)
    shift = _U(64 - FRAGMENTS.bit_length() + 1)

    def run(batches):
        sieve = sent.value
        for b in batches:
            spots = b.column(0).to_numpy(zero_copy_only=False)
            keys, fragments, parts = [], [], []
            for i in np.flatnonzero(sieve[spots >> 6] >> (spots & 63) & 1):
                s = shingles(b.column(1)[int(i)].as_py())
                if len(s):
                    f = (s >> shift).astype(np.int64)
                    key = key_of(s)
                    for at in np.split(np.arange(len(s)), np.flatnonzero(np.diff(f)) + 1):
                        keys.append(key)
                        fragments.append(int(f[at[0]]))
                        parts.append(s[at].astype(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fragments, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["key", "fragment", "part"])

    return map_stream(docs.select(spot.alias("spot"), "text"), run, "key long, fragment int, part array<long>")


def verify(docs: DataFrame, ids: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The linked ones of ``pairs`` (a, b, na, nb), by partial overlaps of fragments."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = ids.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(members, "key", "left_semi")
    parts = scratch.write(_segments(docs, wanted))  # read for both sides of a pair
    left = pairs.join(parts.select(F.col("key").alias("a"), "fragment", F.col("part").alias("pa")), "a")
    both = left.join(parts.select(F.col("key").alias("b"), "fragment", F.col("part").alias("pb")), ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("pa", "pb")).cast("long").alias("k"))
    partial = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("k").alias("k"))  # rows that repeat count once
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k")).where("100 * k >= 75 * (na + nb - k)").select("a", "b")


def close(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """``pairs`` (a, b, na, nb) without those whose wide sketches (key, wide) tell that they can't be linked."""
    large = pairs.where(F.least("na", "nb") > 64 * SKETCH)
    both = large.join(wide.select(F.col("key").alias("a"), F.col("wide").alias("x")), "a").join(wide.select(F.col("key").alias("b"), F.col("wide").alias("y")), "b")
    # sizes of linked sets are within 4 : 3, so the widths are the same or one is twice the other
    half = lambda v: f"zip_with(slice({v}, 1, size({v}) div 2), slice({v}, size({v}) div 2 + 1, size({v}) div 2), (p, q) -> p ^ q)"
    both = both.withColumn("x2", F.expr(f"if(size(x) > size(y), {half('x')}, x)")).withColumn("y2", F.expr(f"if(size(y) > size(x), {half('y')}, y)"))
    kept = both.where("7 * aggregate(zip_with(x2, y2, (p, q) -> bit_count(p ^ q)), 0, (s, k) -> s + k) <= na + nb")
    return kept.select(*pairs.columns).unionByName(pairs.where(F.least("na", "nb") <= 64 * SKETCH))


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every node of ``edges`` (a, b), by alternating large and small stars; root is the least key.

    The least neighbours are checkpointed by themselves, so that both joins shuffle plain tables, whose skew (a star's hub) Spark splits.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = mark(e)
    while before.n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = durable(e)
        least = durable(e.groupBy("u").agg(F.min("v").alias("m")))
        e = e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = durable(e)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("root")).unionByName(e.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


_FIT = "4 * least(na, nb) >= 3 * greatest(na, nb) and 7 * (1 + least(na - 1 - pa, nb - 1 - pb)) >= 3 * (na + nb)"
_SKETCHES = "7 * (" + " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in _BITS) + ") <= na + nb"
_REST = "7 * (c + least(na - 1 - pa, nb - 1 - pb)) >= 3 * (na + nb)"


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    with Scratch(docs.sparkSession) as scratch:
        return _link(docs.select("doc_id", "text"), scratch)


def _link(docs: DataFrame, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    described = durable(_describe(docs))
    ids = described.where("n >= 0").select("doc_id", "n", "key")
    sketches = durable(described.where("key is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in _BITS)))
    wide = described.where("wide is not null").groupBy("key").agg(F.first("wide").alias("wide"))
    side = lambda x: sketches.select(F.col("key").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in _BITS))
    counted = described.where("n < 0").select(F.explode(F.arrays_zip("common", "counts")).alias("x")).groupBy("x.common").agg(F.sum("x.counts").alias("c"))
    often = counted.where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "common").limit(MOST_FREQUENT).toPandas()
    late = often["common"].to_numpy(np.int64).astype(np.uint64)
    hot = often["c"].to_numpy(np.int64) > BUCKET
    hot, parts = late[hot], -(-often["c"].to_numpy(np.int64)[hot] // BUCKET)
    order = np.argsort(hot)
    bucket = Window.partitionBy("shingle", "salt")
    by_size = bucket.orderBy("n", "key")
    posted = _postings(docs, np.sort(late), hot[order], parts[order]).repartition("shingle", "salt")
    posted = posted.select("*", *(F.lag(c).over(by_size).alias(f"b_{c}") for c in ("key", "n", "at")), F.lead("key").over(by_size).alias("next"))
    posted = posted.withColumn("hub", F.max(F.struct("hub", "key", "n", "at")).over(bucket))
    # buckets of one class are gone; a part of a hot bucket says nothing of the others
    shared = scratch.write(posted.where("salt > 0 or b_key <> key or next <> key").drop("next", "salt"))
    release(spark)
    beside, hub = F.struct(F.col("b_key").alias("b"), F.col("b_n").alias("nb"), F.col("b_at").alias("pb")), F.struct(F.col("hub.key").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.at").alias("pb"))
    others = F.array(beside, F.when(F.col("hub.key") != F.coalesce("b_key", "key"), hub))
    near = shared.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.explode(others).alias("x")).select("a", "na", "pa", "x.*").where("a <> b").where(_FIT).repartition("a")
    near = near.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb")).where(_REST)
    near = near.join(side("a"), "a").join(side("b"), "b").where(_SKETCHES)
    # most promising neighbours: those least apart by their sketches; a choice of order, as the rest follows below
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _BITS), F.lit(0))
    nearest = Window.partitionBy("a").orderBy(apart / (F.col("na") + F.col("nb")), F.desc("c"), "b")
    near = near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= FIRST).select("a", "b", "na", "nb")
    texts = ids.where("key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.collect_set("key").alias("all")).where("a <> b")
    same = texts.select("a", F.explode("all").alias("b"))  # one id with several texts
    first = durable(verify(docs, ids, durable(close(durable(near), wide)), scratch).unionByName(same))
    release(spark)
    root = durable(components(first))
    release(spark)
    rooted = shared.select("shingle", "key", "n", "at").distinct().join(root, "key", "left").select("shingle", "key", "n", "at", F.coalesce("root", "key").alias("root"))
    split = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c")).where("low <> high")
    split = durable(split.select("shingle", F.ceil(F.col("c") / BUCKET).cast("int").alias("blocks")))
    rooted = scratch.write(rooted.join(split, "shingle").join(sketches, "key"))
    # a large bucket is cut into blocks of classes, and each pair of blocks is a join key of its own
    own, every = F.pmod(F.col("key"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a, b = (rooted.select("shingle", F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"p{x}"), F.col("root").alias(f"r{x}"), *(F.col(c).alias(f"{x}_{c}") for c in _BITS), (own if x == "a" else every).alias("i"), (every if x == "a" else own).alias("j")) for x in "ab")
    cross = a.join(b, ["shingle", "i", "j"]).where("ra < rb").where(_FIT).where(_SKETCHES).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    # all that two prefixes share is counted; what is left can't share more than the shorter rest
    cross = durable(close(durable(cross.where(_REST).select("a", "b", "na", "nb")), wide))
    release(spark)
    if not cross.isEmpty():
        root = durable(components(first.unionByName(verify(docs, ids, cross, scratch))))
    rows = durable(ids.join(root, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "key").alias("root")))
    # checkpointed by itself, so that the join below shuffles plain tables and Spark splits a large component
    names = durable(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(names, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id. Rows without an id stay.

    Of several rows of that id the one with the least text stays (a null text comes last), at ties that with the least hash of all columns.
    """
    kept = link_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct(F.col("text").isNull().alias("a"), F.col("text").alias("b"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("c"))
    whole = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("r")).select("r.*")
    return whole.unionByName(docs.where("doc_id is null"))


def op2_ngram_jaccard(spark, sf_dir):
    return link_components(table(spark, sf_dir, "documents"))


#: Brute force: every two documents that share a shingle, and all that links reach.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT n, doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) r(i) WHERE len(w) > 0
), c AS (SELECT n, any_value(doc_id) AS doc_id, count(*) AS k FROM s GROUP BY 1
), e AS (
  SELECT a.n AS a, b.n AS b FROM s a JOIN s b USING (g) JOIN c x ON x.n = a.n JOIN c y ON y.n = b.n
  WHERE a.n <> b.n GROUP BY a.n, b.n, x.k, y.k HAVING 100 * count(*) >= 75 * (x.k + y.k - count(*))
  UNION SELECT a.n, b.n FROM c a JOIN c b USING (doc_id) WHERE a.n <> b.n
), reach(a, b) AS (SELECT n, n FROM c UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b
), m AS (SELECT r.a AS n, min(y.doc_id) AS component_id FROM reach r JOIN c y ON y.n = r.b GROUP BY 1)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN c USING (n) LEFT JOIN m USING (n)
"""
