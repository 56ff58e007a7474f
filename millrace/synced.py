"""A set of synced ids in buckets, each part with a Bloom filter, so that a run reads only what may match."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.workspace import flat_schema, one_row, read_if_present, remove_path

BUCKET = "_bucket"
#: Bits that an id sets in a filter.
PROBES = 4
_HEADS = flat_schema(version="bigint", buckets="bigint", index="string")
_PART = T.StructType([T.StructField(BUCKET, T.IntegerType()), T.StructField("path", T.StringType()),
                      T.StructField("ids", T.LongType()), T.StructField("bits", T.LongType()),
                      T.StructField("words", T.ArrayType(T.LongType()))])


def _bucket(ids: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int")


def _places(ids: Column, bits: Column) -> list[Column]:
    """Where an id sets bits; the hashes are other ones than the bucket's."""
    return [F.pmod(F.xxhash64(F.lit(n), ids), bits) for n in range(1, PROBES + 1)]


class SyncedBuckets:
    """Ids that were synced before, as text, in buckets by hash.

    ``add`` writes one part per bucket and a Bloom filter for it; one row of ``heads`` then names the new index, so
    readers see the old set until then, and adding the same ids again changes nothing. ``missing`` tests a
    batch against the filters, which are broadcast, and reads only buckets in which a filter says that an
    id may be there; a batch of new ids reads almost nothing. A bucket with more than ``compact_at`` parts is
    merged into one, without its repeated ids, by the next ``add``; when buckets outgrow ``bucket_ids`` ids, all
    ids are dealt into four times as many. One writer at a time.

    A filter has at most ``most_bits`` bits, so filters take at most buckets x (compact_at + 1) x most_bits / 8 bytes:
    18 MB with 64 buckets. Where that is above ``most_broadcast`` bytes they are joined by a shuffle instead.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, compact_at: int = 8, bucket_ids: int = 2_000_000,
                 most_bits: int = 2 ** 18, most_broadcast: int = 64 * 1024 * 1024):
        self.spark, self.root, self.first_buckets = spark, root.rstrip("/"), buckets
        self.compact_at, self.bucket_ids, self.most_bits, self.most_broadcast = compact_at, bucket_ids, most_bits, most_broadcast

    def at(self, epoch: int) -> SyncedBuckets:
        """The set of one epoch: after a reset of the flow a new one begins."""
        return SyncedBuckets(self.spark, f"{self.root}/epoch{epoch}", self.first_buckets, self.compact_at, self.bucket_ids,
                             self.most_bits, self.most_broadcast)

    def _head(self, back: int = 0):
        heads = read_if_present(self.spark, f"{self.root}/heads", _HEADS).orderBy(F.desc("version")).limit(back + 1).collect()
        return heads[back] if len(heads) > back else None

    def _index(self, head) -> DataFrame:
        if head is None:
            return self.spark.createDataFrame([], _PART)
        return self.spark.read.schema(_PART).parquet(head["index"])

    def _ids(self, paths: list[str]) -> DataFrame:
        schema = flat_schema(id="string")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def parts(self) -> DataFrame:
        """The live parts: bucket, path and number of ids."""
        return self._index(self._head()).select(BUCKET, "path", "ids")

    def read(self) -> DataFrame:
        """All ids, each once."""
        return self._ids([r["path"] for r in self.parts().select("path").collect()]).distinct()

    def add(self, ids: DataFrame) -> None:
        """Add the ids of the first column; rows without an id add nothing."""
        rows = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id IS NOT NULL")
        head = self._head()
        buckets = head["buckets"] if head else self.first_buckets
        live = self.parts().collect()
        grown = buckets
        while sum(r["ids"] for r in live) > grown * self.bucket_ids:
            grown *= 4
        if grown > buckets:
            rows = rows.unionByName(self._ids([r["path"] for r in live]))
            index = self._written(rows, grown)
        else:
            index = self._index(head).unionByName(self._written(rows, buckets)) if head else self._written(rows, buckets)
            index = self._compacted(index, buckets)
        self._commit(index, grown, (head["version"] if head else 0) + 1)

    def _written(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Store ids as one part per bucket; gives the parts' index rows."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, _bucket(F.col("id"), buckets)).repartition(buckets, BUCKET).dropDuplicates([BUCKET, "id"])
        dealt.write.partitionBy(BUCKET).parquet(path)
        stored = self.spark.read.schema(T.StructType([*flat_schema(id="string"), _PART[BUCKET]])).parquet(path)
        wanted = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("ids") * 10, F.lit(64)))))
        # A row per bucket.
        sizes = stored.groupBy(BUCKET).agg(F.count("*").alias("ids")).withColumn(
            "bits", F.least(wanted, F.lit(self.most_bits)).cast("bigint"))
        sized = stored.join(F.broadcast(sizes.select(BUCKET, "bits")), BUCKET)
        place = sized.select(BUCKET, F.explode(F.array(*_places(F.col("id"), F.col("bits")))).alias("place")).selectExpr(
            BUCKET, "place div 64 AS word", "shiftleft(1L, int(place % 64)) AS bit")
        blank = sizes.select(BUCKET, F.explode(F.expr("sequence(0, bits div 64 - 1)")).alias("word"), F.lit(0).cast("bigint").alias("bit"))
        words = (place.unionByName(blank).groupBy(BUCKET, "word").agg(F.bit_or("bit").alias("bit")).groupBy(BUCKET)
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda w: w["bit"]).alias("words")))
        return sizes.join(words, BUCKET).select(BUCKET, F.concat(F.lit(f"{path}/{BUCKET}="), BUCKET).alias("path"), "ids", "bits", "words")

    def _compacted(self, index: DataFrame, buckets: int) -> DataFrame:
        paths = index.groupBy(BUCKET).agg(F.collect_list("path").alias("paths")).where(F.size("paths") > self.compact_at).collect()
        if not paths:
            return index
        merged = self._written(self._ids([p for r in paths for p in r["paths"]]), buckets)
        return index.where(~F.col(BUCKET).isin([r[BUCKET] for r in paths])).unionByName(merged)

    def _commit(self, index: DataFrame, buckets: int, version: int) -> None:
        path = f"{self.root}/index/v{version}-{uuid.uuid4().hex}"
        index.coalesce(8).write.parquet(path)
        one_row(self.spark, _HEADS, (version, buckets, path)).write.mode("append").parquet(f"{self.root}/heads")
        # What only versions before the previous one used is deleted; a reader of that one can finish.
        oldest, before = self._head(2), self._head(1)
        if oldest:
            alive = {r["path"] for head in (before, self._head()) for r in self._index(head).select("path").collect()}
            for gone in {r["path"] for r in self._index(oldest).select("path").collect()} - alive:
                remove_path(self.spark, gone)
            remove_path(self.spark, oldest["index"])

    def _flagged(self, df: DataFrame, key: str, head) -> DataFrame:
        """``df`` with the text of its key, its bucket, and whether any part's filter has it."""
        filters = self._index(head).groupBy(F.col(BUCKET).alias("_b")).agg(F.collect_list(F.struct("bits", "words")).alias("_parts"))
        if head["buckets"] * (self.compact_at + 1) * self.most_bits // 8 <= self.most_broadcast:
            filters = F.broadcast(filters)
        keyed = df.withColumn("_id", F.col(key).cast("string")).withColumn(BUCKET, _bucket(F.col("_id"), head["buckets"]))

        def has(part: Column) -> Column:
            bits = [F.get(part["words"], F.shiftright(at, 6).cast("int")).bitwiseAND(
                F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))) != 0
                for at in _places(F.col("_id"), part["bits"])]
            return reduce(Column.__and__, bits)

        joined = keyed.join(filters, F.col(BUCKET) == F.col("_b"), "left")
        return joined.withColumn("_maybe", F.coalesce(F.exists("_parts", has), F.lit(False)) & F.col("_id").isNotNull())

    def missing(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of ``df`` whose id is not in the set; rows without an id are missing as well."""
        head = self._head()
        if head is None:
            return df
        flagged = self._flagged(df, key, head)
        touched = {r[0] for r in self._flagged(df.select(key), key, head).where("_maybe").select(BUCKET).distinct().collect()}
        if not touched:
            return df
        paths = [r["path"] for r in self.parts().collect() if r[BUCKET] in touched]
        seen = self._ids(paths).withColumnRenamed("id", "_seen")
        doubtful = flagged.where("_maybe").join(seen, F.col("_id") == F.col("_seen"), "left_anti")
        return flagged.where("NOT _maybe").select(*df.columns).unionByName(doubtful.select(*df.columns))
