"""Versioned parquet snapshots with an atomic manifest.

A table is a folder of immutable data directories and small numbered manifests, of which the latest names the live
ones.  A commit writes new directories first and then puts the next manifest in place under a name that must not
exist yet, so readers see the state before or after and nothing in between, a failed load leaves the live table as it
was, and of two writers that began at the same state the second fails instead of undoing the first.

With a ``key`` the rows are split into buckets by a hash of it, and ``replace_chains`` rewrites only the buckets that
hold a touched key.  The number of buckets follows the size of the table when it is committed and stands in the
manifest.  Within a bucket rows are spread over as many tasks as their number asks for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_ROWS, TASK_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 2_000_000, 16, 1 << 17
#: Superseded manifests that stay for readers that have just looked them up.
KEPT_MANIFESTS = 20


class LostUpdate(RuntimeError):
    """Another writer has committed since this one read the table."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS, least_buckets: int = LEAST_BUCKETS):
        self.spark, self.path, self.key, self.bucket_rows, self.least_buckets = spark, path.rstrip("/"), list(key), bucket_rows, least_buckets

    # manifest

    def _hadoop(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark._jsc.hadoopConfiguration()
        return jvm, path, path.getFileSystem(conf), conf

    def _versions(self) -> list[int]:
        _, path, fs, _ = self._hadoop()
        if not fs.exists(path):
            return []
        names = (x.getPath().getName() for x in fs.listStatus(path))
        return sorted(int(n.split(".")[1]) for n in names if n.startswith("MANIFEST.") and n.split(".")[1].isdigit())

    def manifest(self) -> dict | None:
        versions = self._versions()
        if not versions:
            return None
        jvm, _, fs, _ = self._hadoop()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/MANIFEST.{versions[-1]}"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Put the manifest in place, unless there is one of that version."""
        jvm, path, fs, conf = self._hadoop()
        made = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        new, live = made(f"new-{uuid.uuid4().hex}"), made(f"MANIFEST.{manifest['version']}")
        out = fs.create(new, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = getattr(kind, "NONE")  # the rename fails where the version exists
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(new, live, options)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise LostUpdate(f"version {manifest['version']} of {self.path} was committed by another writer") from e
            raise
        for old in self._versions()[:-KEPT_MANIFESTS]:
            fs.delete(made(f"MANIFEST.{old}"), False)

    # reading

    def exists(self) -> bool:
        return bool(self._versions())

    @property
    def version(self) -> int:
        versions = self._versions()
        return versions[-1] if versions else 0

    @property
    def meta(self) -> dict:
        return (self.manifest() or {}).get("meta", {})

    def read(self) -> DataFrame:
        m = self.manifest()
        if m is None:
            raise LookupError(f"no snapshot at {self.path}")
        return self._read(m, sorted({d for own in m["dirs"].values() for d in own}))

    def read_touched(self, touched: DataFrame) -> DataFrame:
        """The rows of the touched keys; only their buckets are read."""
        m = self.manifest()
        if m is None:
            raise LookupError(f"no snapshot at {self.path}")
        touched = touched.select(*self.key).distinct()
        return self._read(m, [d for b in self._hit(touched, m["buckets"]) for d in m["dirs"].get(b, [])]).join(touched, self.key, "left_semi")

    def _read(self, m: dict, dirs: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/{d}" for d in dirs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writing

    def _bucket(self, buckets: int):
        return F.pmod(F.hash(*self.key), F.lit(buckets))

    def _hit(self, touched: DataFrame, buckets: int) -> list[str]:
        """The numbers of the touched buckets, as many as there are at most."""
        return sorted(str(r[0]) for r in touched.select(self._bucket(buckets).alias("b")).distinct().collect())

    def _write(self, df: DataFrame, run: str, buckets: int, rows: int) -> dict[str, list[str]]:
        """Bucket number to directories, for the buckets that got rows."""
        if not self.key:
            df.write.parquet(f"{self.path}/{run}/all")
            return {"0": [f"{run}/all"]}
        # a bucket of very many rows is written by several tasks
        parts = max(1, -(-rows // (buckets * TASK_ROWS)))
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
        tasks = [min(buckets * parts, -(-rows // TASK_ROWS) + 7)] if rows else []
        spread = df.withColumn("_bucket", self._bucket(buckets)).repartition(*tasks, "_bucket", salt)
        spread.write.partitionBy("_bucket").parquet(f"{self.path}/{run}")
        jvm, _, fs, _ = self._hadoop()
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}"))]
        return {n.split("=")[1]: [f"{run}/{n}"] for n in names if n.startswith("_bucket=")}

    def _run(self, version: int) -> str:
        return f"v{version}-{uuid.uuid4().hex[:8]}"

    def commit(self, df: DataFrame, rows: int | None = None, *, after: int | None = None, **meta) -> int:
        """Replace the whole table.  ``rows`` is about how many there are; it decides the number of buckets.

        ``after`` is the version that ``df`` was made from, where that is not the one that is live now.
        """
        version = (self.version if after is None else after) + 1
        rows = rows or 0
        buckets = min(max(self.least_buckets, -(-rows // self.bucket_rows)), MOST_BUCKETS) if self.key else 1
        dirs = self._write(df, self._run(version), buckets, rows)
        self._publish({"version": version, "dirs": dirs, "buckets": buckets, "rows": rows, "schema": df.schema.jsonValue(), "meta": meta})
        return version

    def replace_chains(self, rows: DataFrame, touched: DataFrame, **meta) -> int:
        """Exchange all rows of the touched keys for ``rows``; other buckets are neither read nor written.

        ``touched`` holds the key columns.  The bucket numbers are the only thing that reaches the driver.
        """
        m = self.manifest()
        if m is None:
            return self.commit(rows, **meta)
        touched = touched.select(*self.key).distinct()
        hit = self._hit(touched, m["buckets"])
        if not hit and not meta:
            return m["version"]
        version = m["version"] + 1
        dirs = {b: d for b, d in m["dirs"].items() if b not in hit}
        if hit:
            old = self._read(m, [d for b in hit for d in m["dirs"].get(b, [])])
            kept = old.join(touched, self.key, "left_anti")
            dirs |= self._write(kept.select(*old.columns).unionByName(rows.select(*old.columns)), self._run(version), m["buckets"], m["rows"])
        self._publish(m | {"version": version, "dirs": dirs, "meta": m.get("meta", {}) | meta})
        return version

    def append(self, rows: DataFrame, **meta) -> int:
        """Add rows beside those there are; nothing is read or written again.  The next rewrite of a bucket puts its parts together."""
        m = self.manifest()
        if m is None:
            return self.commit(rows, **meta)
        version = m["version"] + 1
        columns = T.StructType.fromJson(m["schema"]).names
        dirs = dict(m["dirs"])
        for b, own in self._write(rows.select(*columns), self._run(version), m["buckets"], m["rows"]).items():
            dirs[b] = [*dirs.get(b, []), *own]
        self._publish(m | {"version": version, "dirs": dirs, "meta": m.get("meta", {}) | meta})
        return version
