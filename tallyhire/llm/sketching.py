"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles.  Its sketch has one coordinate per bin.  In round i every shingle is
thrown by that round's hash into one bin with a value; a bin keeps the smallest value of the first round that reached it.
After as many rounds as there are bins, round i throws every shingle into bin i, so every coordinate is filled whatever the
size of the set, in time linear in the set plus bins times their logarithm; and agreements of two sketches concentrate
about the similarity as if the bins were independent.

``BANDS`` bands of ``ROWS`` coordinates make candidates: two sets of similarity 0.8 share no band with a probability below
7e-6.  Sets that share a band are a bucket.  No bucket is ever turned into all its pairs.

1. Equal sets are one class; everything after works on classes.
2. Every class is compared with the smallest class that it meets in any bucket: one pair per class.
3. Classes that are now connected need no more comparison.  A bucket that still holds several components is compared as
   a whole: its sets are dealt into parts of about ``PART`` shingles by hash, and each pair of parts is one unit of work that
   finds all intersections through a sorted index and returns a spanning forest of the links it adds.  Buckets with the
   same members are compared once.

Sets are as large as their texts, so they are not kept: those of classes that share a band are made again from the texts.
Every link is verified on the full sets, and every pair that shares a band is either verified or already connected.

Cases: words are split at ASCII white space and A-Z lower-cased; with fewer words than a shingle the whole sequence is one
shingle; without words (null, empty or blank text) the set is empty and links with nothing, its own component; repeated
rows and copies are one class; a null doc_id takes part, is never smaller than another id, and is returned as null; only
doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyhire.llm.common import as_bytes, slices
from tallyhire.llm.components import components
from tallyhire.llm.simhash import forest
from tallyhire.operators.settle import settled
from tallyhire.operators.skew import spread_join

SHINGLE_WORDS = 2
#: A link needs LINK_OF_100 hundredths of the union in the intersection.
LINK_OF_100 = 80
BANDS, ROWS = 30, 5
BINS = BANDS * ROWS
#: Shingles of a part of a bucket.
PART = 1 << 19
#: Balls thrown at once while a sketch is filled.
THROWN = 4096
#: Hashes of words that a worker remembers; it starts anew beyond them.
CACHE_WORDS = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all (multiply, shift and xor, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(_known) > CACHE_WORDS:
        _known.clear()
    for w in set(tokens):
        if w not in _known:
            _known[w] = xxhash.xxh64_intdigest(w)
    h = np.array([_known[w] for w in tokens], np.uint64)
    span = min(words, len(h))
    out = mixed(h[:len(h) - span + 1] + np.uint64(span))
    for k in range(1, span):
        out = mixed(out * _ODD + h[k:len(h) - span + 1 + k])
    return np.unique(out)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One 64-bit value per bin; equal with a probability of the similarity.  ``elements`` must not be empty."""
    out = np.zeros(bins, np.uint64)
    empty = np.ones(bins, bool)
    n, at = len(elements), 0
    size = np.uint64(bins)
    while at < bins and empty.any():
        rounds = min(max(1, THROWN // n), bins - at)
        seeds = mixed(np.arange(at + 1, at + rounds + 1, dtype=np.uint64) * _ODD)
        thrown = mixed(elements[None, :] ^ seeds[:, None]).ravel()
        # bin, round, value: the smallest of a bin is that of its first round
        place = (thrown >> np.uint64(32)) * size >> np.uint64(32)
        when = np.repeat(np.arange(rounds, dtype=np.uint64), n)
        key = np.sort((place << np.uint64(52)) | (when << np.uint64(40)) | (thrown & np.uint64((1 << 40) - 1)))
        where = (key >> np.uint64(52)).astype(np.int64)
        heads = np.flatnonzero(np.diff(where, prepend=-1))
        heads = heads[empty[where[heads]]]
        out[where[heads]] = (key[heads] & np.uint64((1 << 52) - 1)) + (np.uint64(at) << np.uint64(40))
        empty[where[heads]] = False
        at += rounds
    for k in np.flatnonzero(empty).tolist():
        seed = mixed(np.array([bins + k + 1], np.uint64) * _ODD)
        out[k] = (np.uint64(bins + k) << np.uint64(40)) | (mixed(elements ^ seed).min() & np.uint64((1 << 40) - 1))
    return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key per band, different for different bands."""
    parts = values.reshape(bands, -1)
    key = mixed(np.arange(1, bands + 1, dtype=np.uint64) * _ODD)
    for k in range(parts.shape[1]):
        key = mixed(key * _ODD + parts[:, k])
    return key.view(np.int64)


ROWS_DDL = "place long, doc_id long, row_key binary, n_shingles long, digest string, bands array<long>"


def keyed(documents: DataFrame) -> DataFrame:
    """(row_key, doc_id, text): rows of equal key have the same id and text."""
    doc_id = F.col("doc_id").cast("long")
    key = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))))
    return documents.select(key.alias("row_key"), doc_id.alias("doc_id"), "text")


def sketched(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row the size of its set, the digest of its set, and its band keys."""
    schema = pa.schema([("place", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.binary()), ("n_shingles", pa.int64()),
                        ("digest", pa.string()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(list(map(len, sets)), pa.int64()),
                pa.array([xxhash.xxh3_128_hexdigest(s.astype("<u8").tobytes()) for s in sets]),
                pa.array([band_keys(sketch(s)) if len(s) else [] for s in sets], pa.list_(pa.int64()))], schema=schema)

    return keyed(documents).select(F.monotonically_increasing_id().alias("place"), "doc_id", "row_key", "text").mapInArrow(run, ROWS_DDL)


def full_sets(documents: DataFrame, wanted: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(cid, size, elements) of the classes in ``wanted`` (row_key, cid), made from their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(list(map(len, sets)), pa.int64()),
                pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["cid", "size", "elements"])

    texts = keyed(documents).select("row_key", "text").join(wanted, "row_key").select("cid", "text")
    return texts.mapInArrow(run, "cid long, size long, elements binary")


def alike(common, size_a, size_b, link_of_100: int = LINK_OF_100):
    return 100 * common >= link_of_100 * (size_a + size_b - common)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (u, v) pairs, unique by v, those that are linked.

    A frequent u is spread: its pairs are dealt over as many salts as they fill parts, and its set is sent to each salt once.
    """
    per_salt = 64
    heavy = pairs.groupBy("u").agg(F.ceil(F.count("*") / per_salt).alias("salts"))
    left = (
        heavy.join(sets.withColumnRenamed("cid", "u"), "u")
        .select("u", F.col("elements").alias("a"), F.col("salts"), F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"))
    )
    right = pairs.join(sets.withColumnRenamed("cid", "v"), "v").select("u", "v", F.col("elements").alias("b"))
    dealt = spread_join(right, heavy, ["u"], ["v"], weight="salts").withColumn(
        "salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
    met = dealt.select("u", "salt", "v", "b").join(left.select("u", "salt", "a"), ["u", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                keep.append(bool(alike(int((large[at] == small).sum()), len(a), len(b))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return met.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def part_links(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked sets, by a sorted index of all of ``a`` that every set of ``b`` is looked up in."""
    values = np.concatenate(a)
    sizes = np.array([len(s) for s in a])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(a)), sizes)[order]
    left, right = [], []
    for j, s in enumerate(b):
        first, last = np.searchsorted(values, s), np.searchsorted(values, s, "right")
        many = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=len(a))
        near = np.flatnonzero(alike(common, sizes, len(s)) & (common > 0))
        left.append(near)
        right.append(np.full(len(near), j))
    return np.concatenate(left), np.concatenate(right)


def compare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, low, high, part, label, elements), sorted by the first three, to the labels each unit of work links.

    The unit of the parts ``low`` and ``high`` of a bucket compares each set of one with each of the other; a part meets
    itself where both are it.
    """
    def forest_of(parts: dict[int, tuple[list[int], list[np.ndarray]]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        (labels_a, a), (labels_b, b) = (parts.get(k, ([], [])) for k in (low, high))
        labels = np.array(labels_a + (labels_b if low < high else []), np.int64)
        i, j = part_links(a, b) if a and b else (np.empty(0, np.int64), np.empty(0, np.int64))
        names, where = np.unique(labels, return_inverse=True)
        root = forest(where[i], where[j + (len(a) if low < high else 0)], len(names))
        child = np.flatnonzero(root != np.arange(len(names)))
        return names[root[child]], names[child]

    def answer(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(side) for side in zip(*links))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    unit, parts, out = None, {}, []
    for batch in slices(batches):
        for key, low, high, part, label, elements in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (key, low, high) != unit:
                if parts:
                    out.append(forest_of(parts, *unit[1:]))
                unit, parts = (key, low, high), {}
            labels, sets = parts.setdefault(part, ([], []))
            labels.append(label)
            sets.append(np.frombuffer(elements, "<u8"))
        if out:
            yield answer(out)
            out = []
    if parts:
        yield answer([forest_of(parts, *unit[1:])])


def unit_rows(members: DataFrame, part_size: int = PART) -> DataFrame:
    """Members (key, cid, label, size) of unresolved buckets, once per unit of work: (key, low, high, part, cid, label).

    A bucket of k parts has a unit for every part with itself and with every other.
    """
    stats = members.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total"),
        F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("who"),
    ).where("low < high")
    once = stats.groupBy("n", "total", "who").agg(F.min("key").alias("key"))
    buckets = once.select("key", "n", F.ceil(F.col("total") / part_size).cast("int").alias("parts"))
    dealt = spread_join(members, buckets, ["key"], ["cid"], weight="n").where(F.col("parts").isNotNull())
    part = F.pmod(F.xxhash64(F.lit(7), F.col("cid")), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    each = dealt.withColumn("part", part).withColumn("other", other)
    return each.select(
        "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "cid", "label")


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, cid, first): classes that share a band with others, and the smallest of them there.

    The largest buckets, one per shuffle partition, are answered by a broadcast of as many rows.
    """
    each = classes.select("cid", F.explode("bands").alias("key"))
    buckets = settled(each.groupBy("key").agg(F.min("cid").alias("first"), F.count("*").alias("n")).where("n > 1"))
    many = max(128, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(buckets.orderBy(F.desc("n"), "key").limit(many).select("key", "first"))
    cold = each.join(hot, "key", "left_anti").join(buckets.select("key", "first"), "key")
    return each.join(hot, "key").unionByName(cold).select("key", "cid", "first")


def linked_classes(classes: DataFrame, documents: DataFrame, part_size: int = PART) -> DataFrame:
    """(node, root) of the classes that are linked with others: cid and the smallest cid that it reaches.

    ``classes`` (cid, row_key, bands) name one row each of ``documents``.
    """
    members = settled(bucket_members(classes))
    wanted = classes.select("cid", "row_key").join(members.select("cid").distinct(), "cid")
    needed = settled(full_sets(documents, wanted))
    sets = needed.select("cid", "elements")
    stars = members.groupBy("cid").agg(F.min("first").alias("u")).where("u < cid").select("u", F.col("cid").alias("v"))
    links = settled(verified(settled(stars), sets))
    labels = components(links)
    named = needed.select("cid", "size").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    unit = ["key", "low", "high"]
    labelled = members.select("key", "cid").join(named, "cid").select("key", "cid", "size", F.coalesce("root", "cid").alias("label"))
    work = unit_rows(settled(labelled), part_size).join(sets, "cid")
    more = (
        work.select(*unit, "part", "label", "elements").repartition(*unit).sortWithinPartitions(*unit)
        .mapInArrow(compare_parts, "u long, v long")
    )
    return components(labels.select(F.col("root").alias("u"), F.col("node").alias("v")).union(more))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = settled(sketched(documents))
    # a null sorts after every value
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    classes = settled(
        rows.where("n_shingles > 0").groupBy("digest", "n_shingles")
        .agg(F.min(F.struct("place", "row_key")).alias("row"), F.min(key).alias("leader"), F.first("bands").alias("bands"))
        .select("digest", F.col("row.place").alias("cid"), F.col("row.row_key").alias("row_key"), "leader", "bands"))
    found = linked_classes(classes, documents).withColumnRenamed("node", "cid")
    rooted = classes.select("digest", "cid", "leader").join(found, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    leaders = rooted.groupBy("root").agg(F.min("leader").alias("first"))
    answer = rooted.select("digest", "root").join(leaders, "root").select("digest", F.col("first.doc_id").alias("found"), F.lit(True).alias("met"))
    base = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    component = F.when(F.col("met"), F.col("found")).otherwise(F.col("doc_id"))
    joined = spread_join(base, answer, ["digest"], ["doc_id"]).withColumn("component_id", component)
    return joined.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
