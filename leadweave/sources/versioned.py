"""A keyed table that readers can always read while it changes.

Rows are cut into buckets by a hash of their key. A commit merges its rows into the buckets they fall into and writes those buckets to a
new folder; all others stay as they are. What a version consists of is written in a manifest: the folder of each bucket, and the last batch of
each writer. A manifest becomes visible by one rename, so a reader sees the version before or the one after, never a mixture,
and a job that dies in between leaves the table as it was. Two writers that commit at once can't overwrite each other: the second one's
rename is refused, and it merges again onto the first one's version. A batch committed again (a replay) changes nothing.

Next to each bucket lies a filter: one bit for every hash of its keys. ``unknown`` asks the filters first and reads keys only of buckets that a key may
be in, so keys that were never seen read no key column; its answer is exact. State files carry Parquet Bloom filters and are sorted by key, for look-ups
of single keys.

Layout: ``manifests/<version>.json``, ``state/<folder>/bucket=<b>``, ``filters/<folder>/bucket=<b>``. ``vacuum`` removes folders that no recent
version names. The manifest's size depends on the number of buckets and writers only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.session import write_once

_BITMAP = 32_768  # bits of one bitmap value


@dataclass
class Manifest:
    version: int = 0
    schema: str | None = None
    buckets: dict[int, str] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> Manifest:
        raw = json.loads(text)
        return cls(raw["version"], raw["schema"], {int(b): f for b, f in raw["buckets"].items()}, raw["writers"])


class Conflict(RuntimeError):
    """Another writer published the version first."""


class VersionedTable:
    """``key`` names the key column, ``merge`` makes one row per key out of several (partial rows of one key fold in any order).

    The number of buckets and of filter bits (a multiple of 32,768) is chosen when the table is first written and has to stay.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = 64, filter_bits: int = 8 * _BITMAP):
        if filter_bits % _BITMAP:
            raise ValueError(f"filter_bits has to be a multiple of {_BITMAP}")
        self.spark, self.path, self.key, self.merge, self.buckets, self.filter_bits = spark, path.rstrip("/"), key, merge, buckets, filter_bits

    # -- files
    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _text(self, file: str) -> str:
        fs, at = self._fs(file)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest version's manifest, or a given one's."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        if version is not None:
            names = [n for n in names if int(n[:-5]) == version]
        return Manifest.read(self._text(f"{self.path}/manifests/{names[-1]}")) if names else Manifest()

    def _publish(self, made: Manifest) -> None:
        jvm = self.spark._jvm
        name = f"{self.path}/manifests/{made.version:020d}.json"
        fs, draft = self._fs(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(json.dumps(made.__dict__).encode())
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: an existing version is never replaced
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(name), options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {made.version} is taken") from e
            raise

    # -- rows
    def _hash(self, key: str | Column) -> Column:
        return F.xxhash64(F.col(key) if isinstance(key, str) else key)

    def _bucket(self, hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(self.buckets)).cast("int")

    def _bit(self, hashed: Column) -> Column:
        """A key's bit in its bucket's filter: other digits of the hash than those of the bucket."""
        return F.pmod(F.shiftrightunsigned(hashed, 20), F.lit(self.filter_bits))

    def _read(self, kind: str, made: Manifest, schema: T.StructType, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{kind}/{folder}/bucket={b}" for b, folder in made.buckets.items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of the latest version, or of one that has not been vacuumed; of some buckets only, if named."""
        made = self.manifest(version)
        if made.schema is None:
            raise ValueError(f"nothing has been committed to {self.path}")
        return self._read("state", made, T.StructType.fromJson(json.loads(made.schema)), only)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys (one column): only their buckets are read."""
        column = keys.columns[0]
        wanted = {r[0] for r in keys.select(self._bucket(self._hash(column))).distinct().collect()}  # at most as many as there are buckets
        return self.read(only=wanted).join(keys.select(F.col(column).alias(self.key)).distinct(), self.key, "left_semi")

    def commit(self, rows: DataFrame, writer: str, batch_id: int, attempts: int = 10) -> int:
        """Merge rows into the table as one batch of a writer, whose batch numbers rise; the version that holds it.

        A batch that is not above the writer's last one was committed before and is left out.
        """
        made = self.manifest()
        if made.writers.get(writer, -1) >= batch_id:
            return made.version
        fresh = write_once(self.merge(rows).withColumn("bucket", self._bucket(self._hash(self.key))), "commit")
        touched = {r[0] for r in fresh.select("bucket").distinct().collect()}
        for _ in range(attempts):
            folder = f"{made.version + 1:020d}-{uuid.uuid4().hex}"
            schema = T.StructType([f for f in fresh.schema.fields if f.name != "bucket"])
            changed = made.buckets.keys() & touched
            merged = fresh
            if changed:
                old = self._read("state", made, schema, changed)
                merged = self.merge(fresh.drop("bucket").unionByName(old)).withColumn("bucket", self._bucket(self._hash(self.key)))
            self._write(merged, folder)
            try:
                self._publish(Manifest(made.version + 1, schema.json(), made.buckets | dict.fromkeys(touched, folder), made.writers | {writer: batch_id}))
                return made.version + 1
            except Conflict:
                made = self.manifest()
                if made.writers.get(writer, -1) >= batch_id:
                    return made.version
        raise Conflict(f"no version could be published in {attempts} attempts")

    def _write(self, rows: DataFrame, folder: str) -> None:
        out = rows.repartition("bucket").sortWithinPartitions("bucket", self.key)
        bloom = f"parquet.bloom.filter.enabled#{self.key}"
        out.write.partitionBy("bucket").option(bloom, "true").parquet(f"{self.path}/state/{folder}")
        written = self.spark.read.schema(T.StructType([*[f for f in rows.schema.fields if f.name == self.key], T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/state/{folder}")
        bit = self._bit(self._hash(self.key))
        bits = written.select("bucket", F.floor(bit / _BITMAP).cast("int").alias("part"), F.pmod(bit, F.lit(_BITMAP)).cast("long").alias("bit"))
        maps = bits.groupBy("bucket", "part").agg(F.bitmap_construct_agg("bit").alias("map"))
        maps.write.partitionBy("bucket").parquet(f"{self.path}/filters/{folder}")

    def unknown(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose ``column`` is no key of the table; a null is none.

        Keys whose bit is not set are unknown for certain. The others are held against the keys of their buckets.
        """
        made = self.manifest()
        if not made.buckets:
            return rows
        hashed, bit = self._hash(f"`{column}`"), self._bit(self._hash(f"`{column}`"))
        placed = rows.select(F.struct("*").alias("row"), F.col(f"`{column}`").alias("_key"), self._bucket(hashed).alias("bucket"), F.floor(bit / _BITMAP).cast("int").alias("part"), F.pmod(bit, F.lit(_BITMAP)).alias("bit"))
        schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("map", T.BinaryType()), T.StructField("bucket", T.IntegerType())])
        filters = self._filters(made, schema)
        byte = F.conv(F.hex(F.substring(F.col("map"), (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        is_set = F.coalesce(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1, F.lit(False))
        asked = write_once(placed.join(filters, ["bucket", "part"], "left").select("row", "_key", "bucket", is_set.alias("maybe")), "asked")
        new, maybe = asked.filter(~F.col("maybe")), asked.filter("maybe")
        touched = {r[0] for r in maybe.select("bucket").distinct().collect()}
        if touched:
            known = self.read(made.version, touched).select(F.col(self.key).alias("_key"))
            new = new.unionByName(maybe.join(known, "_key", "left_anti").select(*new.columns))
        return new.select("row.*")

    def _filters(self, made: Manifest, schema: T.StructType) -> DataFrame:
        folders: dict[str, list[int]] = {}
        for b, folder in made.buckets.items():
            folders.setdefault(folder, []).append(b)
        paths = [f"{self.path}/filters/{folder}/bucket={b}" for folder, held in folders.items() for b in held]
        by_file = self.spark.read.schema(T.StructType(schema.fields[:2])).parquet(*paths)
        bucket = F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/[^/]*$", 1).cast("int")
        return by_file.select("part", "map", bucket.alias("bucket"))

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` manifests, and the folders that none of those names. No reader may still be at an older version,
        and no commit may be under way."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        kept = [Manifest.read(self._text(f"{self.path}/manifests/{n}")) for n in names[-keep:]]
        used = {folder for m in kept for folder in m.buckets.values()}
        gone = [f"manifests/{n}" for n in names[:-keep]] + [f"{kind}/{n}" for kind in ("state", "filters") for n in self._names(kind) if n not in used]
        for name in gone:
            fs, at = self._fs(f"{self.path}/{name}")
            fs.delete(at, True)
