"""Size-tiered compaction of a table of immutable Parquet shards under versioned manifests.

append() writes arrivals as small shards that never change, compact() merges runs of similarly sized shards into files
of about the target size, and each change becomes visible by one atomic commit of the next manifest. A manifest lists every shard
with rows and bytes; its file is written under a name of its own and renamed to v<number>.json without leave to replace, so that a number is taken once; the file
is then read again, and a writer that finds another's token in it has lost. (A store whose rename may replace needs conditional writes for that.) Readers see one version,
whole; shards that no manifest names belong to a writer that hasn't committed yet or was lost, and are never read. expire() removes old versions and
then the shards that no version names any more, but none that was written within GRACE, as a writer may still commit it. Data moves without a shuffle: a merge coalesces the splits of the due shards, so that a task writes about a target
of bytes. Everything is DataFrame reads and writes; the driver holds names and sizes of shards only.

Rows with nulls in any column, repeated rows and columns of any name are kept as they are; appending an empty table adds no shard
and still commits a version; compacting a table without a full tier commits nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a finished shard, similar shards that make a tier due for a merge, ratio of sizes from a tier to the next.
TARGET, FAN_IN, RATIO = 128 << 20, 4, 4
#: Seconds for which files that no manifest names are kept.
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed the version; read again and retry."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    size: int


class ShardedTable:
    """A folder of shards and manifests; every method that changes it commits a new version."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.fs.exists(self.paths(f"{self.root}/manifest")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.paths(f"{self.root}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """Version (the last one by default; 0: none yet), its shards, the schema as JSON."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, [], None
        told = self.told(version)
        return version, [Shard(**s) for s in told["shards"]], told["schema"]

    def told(self, version: int) -> dict:
        stream = self.fs.open(self.paths(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, shards: list[Shard], schema: str) -> int:
        """Makes shards the version after base, or raises if that version is there already."""
        folder = self.paths(f"{self.root}/manifest")
        self.fs.mkdirs(folder)
        token = uuid.uuid4().hex
        draft, final = (self.fs.makeQualified(self.paths(f"{self.root}/manifest/{n}")) for n in (f".draft-{token}", f"v{base + 1:08d}.json"))
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"version": base + 1, "token": token, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            stream.close()
        if not self.renamed(draft, final) or self.told(base + 1)["token"] != token:
            self.fs.delete(draft, False)
            raise Conflict(f"version {base + 1} was committed by another writer")
        return base + 1

    def renamed(self, draft, final) -> bool:
        """Whether draft took the name final; not if something has it."""
        from py4j.protocol import Py4JJavaError

        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def written(self, df: DataFrame, rows_a_file: int = 0) -> list[Shard]:
        """The shards that df becomes, each named once and for all, with rows as counted from the files."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).parquet(folder)
        return self.listed(folder)

    def listed(self, folder: str) -> list[Shard]:
        sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.paths(folder)) if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        counted = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).count().collect()
        return [Shard(f"{folder}/{r['name']}", r["count"], sizes[r["name"]]) for r in sorted(counted)]

    def append(self, df: DataFrame, rows_a_file: int = 0) -> int:
        """Arrivals as small shards: a file for each input split, and at most rows_a_file rows in it."""
        base, shards, _ = self.manifest()
        return self.commit(base, shards + self.written(df, rows_a_file), df.schema.json())

    def tier(self, shard: Shard) -> int:
        """0: finished; else the number of times that the size goes into the target by RATIO."""
        n, size = 0, max(1, shard.size)
        while size * 2 <= self.target:
            n, size = n + 1, size * RATIO
        return n

    def compact(self) -> int:
        """One merge of each tier that is due, small tiers together with those they grow into; the version that holds now."""
        base, shards, schema = self.manifest()
        due: list[Shard] = []
        for t in range(max(map(self.tier, shards), default=0), 0, -1):
            own = [s for s in shards if self.tier(s) == t]
            if len(own) + (1 if due else 0) >= FAN_IN:
                due += own
        if not due:
            return base
        keep = [s for s in shards if s not in set(due)]
        parts = max(1, -(-sum(s.size for s in due) // self.target))
        rows = self.shards(due, schema)
        merged = self.written(rows.coalesce(parts))
        if sum(s.rows for s in merged) != sum(s.rows for s in due):
            raise RuntimeError("a merge must keep every row")
        return self.commit(base, keep + merged, schema)

    def shards(self, shards: list[Shard], schema: str | None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType()
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version (the last one by default)."""
        _, shards, schema = self.manifest(version)
        return self.shards(shards, schema)

    def expire(self, versions: int = 1, grace: float = GRACE) -> int:
        """Keeps the last `versions` manifests, and removes the shards that none of them names and that are older than grace seconds. Returns how many shards went."""
        every = self.versions()
        kept = every[-max(1, versions) :]
        for version in every[: -len(kept)] if kept else []:
            self.fs.delete(self.paths(f"{self.root}/manifest/v{version:08d}.json"), False)
        named = {s.path.split("/data/")[1] for version in kept for s in self.manifest(version)[1]}
        before, gone = (time.time() - grace) * 1000, 0
        if not self.fs.exists(self.paths(f"{self.root}/data")):
            return 0
        for folder in self.fs.listStatus(self.paths(f"{self.root}/data")):
            for f in self.fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.endswith(".parquet") and f"{folder.getPath().getName()}/{name}" not in named and f.getModificationTime() <= before:
                    gone += bool(self.fs.delete(f.getPath(), False))
        return gone


def compacted(arrivals: DataFrame, root: str, rows_a_file: int, target: int = TARGET) -> ShardedTable:
    """arrivals appended as small shards, then merged until no tier is due."""
    table = ShardedTable(arrivals.sparkSession, root, target)
    now = table.append(arrivals, rows_a_file)
    while (after := table.compact()) != now:
        now = after
    return table
