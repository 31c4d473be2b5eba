"""Sharding by size-tiered compaction: small immutable shards, merged runs, versioned manifests. DataFrame operations only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import new_folder, table, whole_rows

#: Bytes of text (UTF-8) in a full shard, and how many shards of one size tier make a run.
TARGET_BYTES = 64 << 20
FAN_IN = 4
#: Documents in an appended shard, and runs that one compaction commits, at most.
APPEND_ROWS = 4_096
RUNS = 20_000

_MANIFEST = "shard string, folder string, file string, tier int, rows long, bytes long"


@dataclass
class ShardStore:
    """Shards under ``path``: files in data/<attempt>/, shard lists in lists/<attempt>/, versions in manifests/v<version>.

    Shards are never changed. ``append`` adds the files that its tasks write as they come, without a shuffle; ``compact``
    merges shards of like size and leaves the old ones to readers of older versions. Every attempt writes to folders of
    its own and ends with a commit: a file that names the attempt's list is put in place as the next version, if there is
    none. So a version is whole or absent, of two writers one gets an error, and an attempt that died can be repeated;
    what it left is listed nowhere, and ``vacuum`` removes it. Shards are named after version, arrival or tier, and file
    or run number, not after the attempt. Readers use the newest version and open only the folders that it lists.
    """

    spark: SparkSession
    path: str
    target_bytes: int = TARGET_BYTES
    fan_in: int = FAN_IN

    # -- manifests -------------------------------------------------------------------------------------------------

    def _hadoop(self):
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        return hadoop, hadoop.Path(self.path).getFileSystem(conf), conf

    def _names(self, folder: str) -> list[str]:
        hadoop, fs, _ = self._hadoop()
        where = hadoop.Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("manifests") if n.startswith("v"))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max([0, *self.versions()])

    def manifest(self, version: int | None = None) -> DataFrame:
        """shard, folder, file, tier, rows, bytes of a version (by default the newest)."""
        v = self.version() if version is None else version
        if v == 0:
            return self.spark.createDataFrame([], _MANIFEST)
        listed = self.spark.read.text(f"{self.path}/manifests/v{v:08d}").first()[0]
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/lists/{listed}")

    def _attempt(self, version: int, name: str) -> str:
        return f"v{version:08d}-{name}-{uuid.uuid4().hex[:12]}"

    def _commit(self, shards: DataFrame, version: int, attempt: str) -> None:
        shards.coalesce(1).write.parquet(f"{self.path}/lists/{attempt}")
        hadoop, fs, conf = self._hadoop()
        jvm = self.spark._jvm
        aside, to = (hadoop.Path(f"{self.path}/{x}") for x in (f"pending/{attempt}", f"manifests/v{version:08d}"))
        out = fs.create(aside, True)
        out.writeBytes(attempt)
        out.close()
        fs.mkdirs(to.getParent())
        try:
            if fs.getUri().getScheme() == "file":  # where a rename would replace
                local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (to, aside)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                rename = getattr(hadoop, "Options$Rename")
                how = self.spark.sparkContext._gateway.new_array(rename, 1)
                how[0] = rename.NONE  # fails if the version is there
                hadoop.FileContext.getFileContext(to.toUri(), conf).rename(aside, to, how)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise RuntimeError(f"version {version} of {self.path} was committed by another writer") from e
            raise

    def _tier(self, size):
        """0 for shards below target / fan_in^2, one more for each factor of fan_in, 3 for full ones."""
        return sum((size >= self.target_bytes // self.fan_in**k).cast("int") for k in (2, 1, 0))

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the newest ``keep`` versions, the files that none of those lists, and what lost attempts left.

        Attempts at the version after the newest may be under way and stay.
        """
        all_ = self.versions()
        kept, newest = all_[-keep:], self.version()
        folders, lists = set(), set()
        for v in kept:
            lists.add(self.spark.read.text(f"{self.path}/manifests/v{v:08d}").first()[0])
            folders |= {r["folder"] for r in self.manifest(v).select("folder").distinct().collect()}  # one per commit at most
        hadoop, fs, _ = self._hadoop()
        for v in all_[:-keep]:
            fs.delete(hadoop.Path(f"{self.path}/manifests/v{v:08d}"), False)
        for place, used in (("data", folders), ("lists", lists), ("pending", set())):
            for name in self._names(place):
                if name not in used and int(name[1:9]) <= newest:
                    fs.delete(hadoop.Path(f"{self.path}/{place}/{name}"), True)

    # -- data ------------------------------------------------------------------------------------------------------

    def _files(self, schema: StructType, folders: list[str]) -> DataFrame:
        """(row, bytes, file) of all files in the folders."""
        schema = StructType([StructField("row", schema), StructField("bytes", LongType())])
        read = self.spark.read.schema(schema)
        rows = read.parquet(*(f"{self.path}/data/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)
        return rows.withColumn("file", F.col("_metadata.file_name") if folders else F.lit(""))

    def _measured(self, schema: StructType, folder: str, name) -> DataFrame:
        """The manifest rows of the files in a new folder, from their column of text sizes alone."""
        part = F.regexp_extract("file", r"^part-(\d+)", 1)
        counted = self._files(schema, [folder]).groupBy("file").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
        return counted.select(name(part, F.regexp_extract("file", r"c(\d+)\.", 1)).alias("shard"), F.lit(folder).alias("folder"), "file", self._tier(F.col("bytes")).alias("tier"), "rows", "bytes")

    def append(self, documents: DataFrame, arrival: str) -> int:
        """Writes ``documents`` as small shards named after ``arrival`` and commits them; returns the version.

        Arrivals without rows commit a version that lists the same shards.
        """
        old = self.version()
        folder = self._attempt(old + 1, arrival)
        size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
        rows = documents.select(whole_rows(documents).alias("row"), size.alias("bytes"))
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", APPEND_ROWS).parquet(f"{self.path}/data/{folder}")
        name = lambda part, n: F.concat_ws("/", F.lit(f"v{old + 1:08d}"), F.lit(arrival), F.concat_ws("-", part, n))
        self._commit(self.manifest(old).unionByName(self._measured(documents.schema, folder, name)), old + 1, folder)
        return old + 1

    def plan(self, shards: DataFrame, force: bool = False) -> DataFrame:
        """(shard, run): which shards of the manifest merge into which run, runs numbered from 0.

        In each tier but the last the shards stand by size and name; ``fan_in`` or more of a tier are cut to runs of
        about ``target_bytes``. Tiers with fewer shards wait (with ``force`` they merge too), and a shard that would be a
        run by itself stays. One row per shard, not per document, so the windows are over a small table.
        """
        order = Window.partitionBy("tier").orderBy("bytes", "shard")
        before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        many = F.count("*").over(Window.partitionBy("tier")) >= (2 if force else self.fan_in)
        small = shards.where(F.col("tier") < 3).withColumn("many", many).withColumn("cut", F.floor(before / F.lit(self.target_bytes))).where("many")
        merged = small.withColumn("n", F.count("*").over(Window.partitionBy("tier", "cut"))).where("n > 1")
        return merged.select("shard", (F.dense_rank().over(Window.orderBy("tier", "cut")) - 1).cast("int").alias("run")).where(F.col("run") < RUNS)

    def compact(self, schema: StructType, force: bool = False) -> int:
        """Merges like-sized shards into runs of about target size until no tier is due; returns the version.

        Each run is written by a task of its own. Every ``RUNS`` runs are a commit. Very long texts make a shard larger
        than the target, never a split document. Nothing to merge: no new version.
        """
        while True:
            old = self.version()
            shards = self.manifest(old)
            plan = self.plan(shards, force)
            n = plan.agg(F.max("run")).first()[0]
            if n is None:
                return old
            folder = self._attempt(old + 1, "merged")
            moved = self.placed(schema, old).join(plan, "shard").select("row", "row_bytes", "run")
            moved = moved.repartitionById(n + 1, "run").select("row", F.col("row_bytes").alias("bytes"))
            moved.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(f"{self.path}/data/{folder}")
            name = lambda part, _: F.concat(F.lit(f"v{old + 1:08d}/merged/"), part)
            kept = shards.join(plan.select("shard"), "shard", "left_anti")
            self._commit(kept.unionByName(self._measured(schema, folder, name)), old + 1, folder)

    def placed(self, schema: StructType, version: int | None = None) -> DataFrame:
        """(row, row_bytes, shard, tier, rows, bytes): each document of a version as one struct, with the shard that holds it."""
        listed = self.manifest(version)
        folders = sorted(r["folder"] for r in listed.select("folder").distinct().collect())  # one per commit at most
        rows = self._files(schema, folders).withColumnRenamed("bytes", "row_bytes")
        return rows.join(listed.drop("folder"), "file").select("row", "row_bytes", "shard", "tier", "rows", "bytes")

    def documents(self, schema: StructType, version: int | None = None) -> DataFrame:
        """The documents of a version, with their columns as they were."""
        return self.placed(schema, version).select("row.*")


def shard(documents: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardStore:
    """Appends ``documents`` to a store and compacts it; returns the store.

    Null texts count 0 bytes. Repeated rows are each kept. A table without rows gives a store without shards. Columns of
    any name are kept, as a document is stored as one struct.
    """
    spark = documents.sparkSession
    store = ShardStore(spark, path or new_folder(spark, "shards"), target_bytes, fan_in)
    store.append(documents, "documents")
    store.compact(documents.schema)
    return store


def assignments(store: ShardStore, documents: DataFrame) -> DataFrame:
    """(shard, doc_id, tier, shard_rows, shard_bytes) of every stored document."""
    return store.placed(documents.schema).select("shard", "row.doc_id", "tier", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return assignments(shard(documents), documents)


QUERIES = {"op10_sharding": op10_sharding}
