"""Substring search by trigram: which postings can hold the typed text, without reading the others.

``SearchStore`` keeps, in one folder of the shared storage,

* ``rows/shard=…``: the postings, cut by a hash of their id (a column named ``shard`` is replaced); ``shape``: their columns;
* ``grams/batch=…/bucket=…``: (field, gram, key), sorted by gram, for every three letters in a row of a searched field; the key
  is the hash of the posting's id that also names its shard, a sixth as long as an id;
* ``counts/batch=…/bucket=…``: how many postings hold a gram.

A search looks up the counts of the typed text's grams, takes the rarest gram per field, and meets its postings with the rows.
The broadcast side is as large as its count says; the shards without a candidate are then never opened (partition pruning at
run time).  What is found is verified with the plain predicate, so the index only has to hold enough: an upsert appends the
grams of the rows it added or changed and leaves outdated ones, which verification discards and ``build`` clears.

Texts under three letters, and texts whose rarest gram is held by more than ``MOST_CANDIDATES`` rows, scan all rows.
Null and empty fields hold nothing.  Grams are made from lower-cased code points, as ``contains_typed`` compares them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from tallyhire.functions.text import contains_typed

FIELDS = ("company", "title", "location")
BUCKETS = 64
SHARDS = 64
#: A candidate is a key and a shard, under 150 bytes: the broadcast stays below 30 MB.
MOST_CANDIDATES = 200_000
WIDTH = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text; in one pass, by code points."""
    letters = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))
    at = F.sequence(F.lit(1), F.greatest(F.size(letters) - WIDTH + 1, F.lit(1)))
    whole = F.transform(at, lambda i: F.array_join(F.slice(letters, i, WIDTH), ""))
    return F.when(F.size(letters) >= WIDTH, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(key, F.lit(parts)).cast("int")


def _hashed(value: Column, parts: int) -> Column:
    return _part(F.xxhash64(value), parts)


class SearchStore:
    """Postings with a trigram index, stored under ``folder``; the id column is unique."""

    def __init__(self, spark: SparkSession, folder: str, fields: Sequence[str] = FIELDS, shards: int = SHARDS,
                 buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.fields = spark, folder, tuple(fields)
        self.shards, self.buckets = shards, buckets

    def build(self, postings: DataFrame) -> SearchStore:
        """Write the rows and their index anew."""
        shape = StructType([f for f in postings.schema if f.name != "shard"]).json()
        self.spark.createDataFrame([(shape,)], "shape string").write.mode("overwrite").parquet(f"{self.folder}/shape")
        self._write(postings.withColumn("shard", _hashed(F.col("id"), self.shards)), "rows", ["shard"], "static")
        self._index(self.rows(), "0", "static")
        return self

    def rows(self) -> DataFrame:
        """The stored postings, ``shard`` last; their columns are stored beside them, so no row at all is fine too."""
        shape = StructType.fromJson(json.loads(self.spark.read.parquet(f"{self.folder}/shape").first()["shape"]))
        return self.spark.read.schema(shape.add("shard", IntegerType())).parquet(f"{self.folder}/rows")

    def merge(self, batch: DataFrame, merged: DataFrame, batch_id: str) -> None:
        """Take over what an upsert made: ``merged`` is the whole table after it, ``batch`` the ids it touched.

        Only shards that hold a touched id are written; only touched rows are indexed.  ``merged`` must not read
        the store's own folder lazily: settle it first.  The same batch run again replaces what it wrote before.
        """
        ids = batch.select("id").filter("id IS NOT NULL").distinct().withColumn("shard", _hashed(F.col("id"), self.shards))
        after = merged.withColumn("shard", _hashed(F.col("id"), self.shards))
        touched = ids.select("shard").distinct()  # at most ``shards`` rows
        self._write(after.join(F.broadcast(touched), "shard", "left_semi"), "rows", ["shard"], "dynamic")
        self._index(after.join(ids.select("id"), "id", "left_semi"), batch_id, "dynamic")

    def _write(self, rows: DataFrame, name: str, parts: list[str], overwrite: str, order: Sequence[str] = ()) -> None:
        """Rebalancing cuts what is too large for one task: a frequent gram fills several files of its bucket."""
        rows.hint("rebalance", parts[-1]).sortWithinPartitions(*parts, *order).write.mode("overwrite").option(
            "partitionOverwriteMode", overwrite).partitionBy(*parts).parquet(f"{self.folder}/{name}")

    def _index(self, rows: DataFrame, batch_id: str, overwrite: str) -> None:
        held = F.array(*[F.struct(F.lit(f).alias("field"), grams(F.col(f)).alias("grams")) for f in self.fields])
        each = rows.select(F.xxhash64("id").alias("key"), F.explode(held).alias("h")).select(
            "key", "h.field", F.explode_outer("h.grams").alias("gram")).filter("gram IS NOT NULL")
        placed = each.select("*", F.lit(batch_id).alias("batch"), _hashed(F.col("gram"), self.buckets).alias("bucket"))
        self._write(placed, "grams", ["batch", "bucket"], overwrite, ["gram", "field"])
        written = self._read("grams", "field string, gram string").filter(F.col("batch") == batch_id)
        self._write(written.groupBy("batch", "bucket", "gram", "field").agg(F.count("*").alias("n")),
                    "counts", ["batch", "bucket"], overwrite, ["gram"])

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch string, bucket int").parquet(f"{self.folder}/{name}")

    def _lookup(self, name: str, schema: str, wanted: Sequence[str]) -> DataFrame:
        """Index rows of some grams; their buckets are constants, so no other bucket is opened."""
        return self._read(name, schema).filter(F.col("bucket").isin(*[_hashed(F.lit(g), self.buckets) for g in wanted]) & F.col("gram").isin(*wanted))

    def rarest(self, typed: str, fields: Sequence[str]) -> dict[str, tuple[str, int]]:
        """Per field the gram of the typed text that the fewest rows hold, with that number; reads one count per gram.

        ``%`` and ``_`` are wildcards in what a user types, so grams come from the pieces between them.
        """
        pieces = self.spark.range(1).select(F.explode(F.split(F.lower(F.lit(typed)), "[%_]")).alias("piece"))
        words = [r["gram"] for r in pieces.select(F.explode(grams(F.col("piece"))).alias("gram")).distinct().collect()]
        if not words:
            return {}
        counts = self._lookup("counts", "gram string, field string, n long", words).filter(F.col("field").isin(*fields))
        found = {(r["field"], r["gram"]): r["n"] for r in counts.groupBy("field", "gram").agg(F.sum("n").alias("n")).collect()}
        return {f: min(((g, found.get((f, g), 0)) for g in words), key=lambda e: (e[1], e[0])) for f in fields}

    def candidates(self, typed: str, fields: Sequence[str]) -> DataFrame | None:
        """(key, shard) of the rows that may hold the text in one of the fields; None where all rows must be read."""
        best = self.rarest(typed, fields)
        if not best or sum(n for _, n in best.values()) > MOST_CANDIDATES:
            return None
        held = self._lookup("grams", "key long, field string, gram string", sorted({g for g, _ in best.values()}))
        pairs = [(F.col("field") == f) & (F.col("gram") == g) for f, (g, _) in best.items()]
        wanted = pairs[0]
        for p in pairs[1:]:
            wanted = wanted | p
        return held.filter(wanted).select("key", _part(F.col("key"), self.shards).alias("shard"))

    def find(self, typed: str, fields: Sequence[str] | None = None) -> DataFrame:
        """All rows that hold the typed text in one of the fields (blank: all rows), as the plain filter finds them."""
        fields = tuple(fields or self.fields)
        typed = typed.strip()
        if not typed:
            return self.rows().drop("shard")
        holds = contains_typed(fields[0], typed)
        for f in fields[1:]:
            holds = holds | contains_typed(f, typed)
        near = self.candidates(typed, fields)
        rows = self.rows()
        if near is not None:
            keyed = rows.filter("id IS NOT NULL").withColumn("key", F.xxhash64("id"))
            rows = keyed.join(F.broadcast(near), ["shard", "key"], "left_semi").select(*rows.columns)
        return rows.filter(holds).drop("shard")
