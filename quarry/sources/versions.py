"""Tables with versions: rows lie in buckets by a hash of their key, and a version is a small file that says where each bucket is.

An upsert or a delete rewrites the buckets that its keys hit, into a folder of its own, and becomes visible by one rename of the
new version's file, which fails if another writer was first. What a version names is never changed, so older versions stay
readable until they are expired, and a write that ends early leaves only a folder that nothing names.

Defined cases: rows with a null in their key are keyed by it like any other; of several new rows with a key the first in the
given order stays; unknown conditions delete nothing; a write that changes no bucket makes a version that is equal to the last.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.tables import latest

#: Name of the column that folders of a write are named by.
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # files that say what a version is

    def _at(self, *parts):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read."""
        folder = self._at("versions")
        fs = folder.getFileSystem(self._conf)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """What the last version or a given one says."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"no version {version or ''} of {self.path}")
        text = self.spark.read.text(str(self._at("versions", f"{version or known[-1]}.json")), wholetext=True).head()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        number, draft = manifest["version"], self._at("versions", f".{uuid.uuid4().hex}")
        out = draft.getFileSystem(self._conf).create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        try:  # a rename that never overwrites
            self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, self._at("versions", f"{number}.json"), self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception as e:
            draft.getFileSystem(self._conf).delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {number} of {self.path} exists") from None
            raise
        return number

    # rows

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(*manifest["key"]), F.lit(manifest["buckets"])).cast("int")

    def _write(self, rows: DataFrame, manifest: dict) -> list[int]:
        """Rows in a new folder by bucket, each bucket in one file; the buckets that got any."""
        manifest["write"] = uuid.uuid4().hex
        folder = f"{self.path}/data/{manifest['write']}"
        rows.withColumn(BUCKET, self._bucket(manifest)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        at = self._hadoop.Path(folder)
        return sorted(int(f.getPath().getName().partition("=")[2]) for f in at.getFileSystem(self._conf).listStatus(at) if f.isDirectory() and f.getPath().getName().startswith(BUCKET))

    def _rows(self, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        some = manifest["places"] if buckets is None else {str(b): manifest["places"][str(b)] for b in buckets if str(b) in manifest["places"]}
        paths = [f"{self.path}/data/{write}/{BUCKET}={b}" for b, write in sorted(some.items(), key=lambda x: int(x[0]))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _hit(self, rows: DataFrame, manifest: dict) -> list[int]:
        """Buckets of the rows' keys: at most as many as the table has."""
        return sorted(r[0] for r in rows.select(self._bucket(manifest)).distinct().collect())

    def _replace(self, manifest: dict, hit: list[int], rows: DataFrame) -> int:
        """The next version: the buckets that are hit hold these rows, all others stay where they are."""
        nxt = manifest | {"version": manifest["version"] + 1, "places": dict(manifest["places"])}
        written = self._write(rows, nxt) if hit else []
        for b in hit:
            nxt["places"].pop(str(b), None)
        return self._commit(nxt | {"places": nxt["places"] | {str(b): nxt["write"] for b in written}})

    def create(self, rows: DataFrame, key: list[str], buckets: int = 64) -> int:
        """The first version. Keys should be unique."""
        if self.versions():
            raise Conflict(f"{self.path} exists")
        manifest = {"version": 1, "key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "places": {}}
        written = self._write(rows, manifest)
        return self._commit(manifest | {"places": {str(b): manifest["write"] for b in written}})

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the last version or a given one."""
        return self._rows(self.manifest(version))

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows with these keys; other keys' buckets aren't read."""
        manifest = self.manifest(version)
        rows = self._rows(manifest, self._hit(keys, manifest))
        return rows.join(keys.select(*(F.col(k).alias(f"_{k}") for k in manifest["key"])), self._same(manifest), "left_semi")

    @staticmethod
    def _same(manifest: dict) -> Column:
        condition = F.lit(True)
        for k in manifest["key"]:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return condition

    def upsert(self, new: DataFrame, order: list) -> int:
        """Rows of new in place of those with their key. Of several with one key the first in this order stays."""
        manifest = self.manifest()
        new = latest(new, manifest["key"], order).select(*(f["name"] for f in manifest["schema"]["fields"]))
        hit = self._hit(new, manifest)
        old, keys = self._rows(manifest, hit), new.select(*(F.col(k).alias(f"_{k}") for k in manifest["key"]))
        return self._replace(manifest, hit, old.join(keys, self._same(manifest), "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> int:
        """Rows with these keys go."""
        manifest = self.manifest()
        hit = self._hit(keys, manifest)
        keys = keys.select(*(F.col(k).alias(f"_{k}") for k in manifest["key"]))
        return self._replace(manifest, hit, self._rows(manifest, hit).join(keys, self._same(manifest), "left_anti"))

    def delete_where(self, condition: Column) -> int:
        """Rows that the condition holds for go; buckets without any stay where they are."""
        manifest = self.manifest()
        gone = F.coalesce(condition, F.lit(False))
        hit = self._hit(self._rows(manifest).where(gone), manifest)
        return self._replace(manifest, hit, self._rows(manifest, hit).where(~gone))

    def update_where(self, condition: Column, values: dict[str, Column]) -> int:
        """Columns set on the rows that the condition holds for; keys can't be set."""
        manifest = self.manifest()
        if set(values) & set(manifest["key"]):
            raise ValueError("a key can't be set")
        holds = F.coalesce(condition, F.lit(False))
        hit = self._hit(self._rows(manifest).where(holds), manifest)
        rows = self._rows(manifest, hit)
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        # all at once, so that neither the condition nor a value sees what another one has set
        return self._replace(manifest, hit, rows.withColumns({c: F.when(holds, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}))

    def expire(self, keep: int = 1) -> list[int]:
        """Drops all but the last versions, and the folders that none of those names; the numbers that are gone. No write may run meanwhile."""
        known = self.versions()
        gone, left = known[:-keep], known[-keep:]
        named = {w for v in left for w in self.manifest(v)["places"].values()}
        for v in gone:
            at = self._at("versions", f"{v}.json")
            at.getFileSystem(self._conf).delete(at, False)
        data = self._at("data")
        fs = data.getFileSystem(self._conf)
        for f in fs.listStatus(data):
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)
        return gone
