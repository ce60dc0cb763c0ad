"""Versioned tables: a version is a small manifest file that names the data folders it consists of.

A manifest is written aside and renamed to the next number, which one writer alone can take, so a reader
sees the last complete version whatever happens to a writer. Rows are dealt into buckets by a key, and a
version shares with the one before all buckets that it does not change. A lock file admits one writer; a
writer that died stops renewing it, and after its lease another one takes it.
"""
from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
_BUCKET = "_bucket"


class VersionedStore:
    """``key``: the column whose hash deals rows into buckets; without one the table is a single bucket."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str | None = None, lock_seconds: float = 30.0, lease_seconds: float = 60.0):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.lock_seconds, self.lease_seconds = lock_seconds, lease_seconds
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.fs.mkdirs(self._path(f"{self.root}/_versions"))

    # ---- versions

    def _manifests(self) -> list[str]:
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/_versions"))) if n.endswith(".json") and not n.startswith((".", "_")))

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/_versions/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """{version, buckets: {bucket: folder}} of the current version; no buckets where nothing was committed."""
        names = self._manifests()
        return self._read(names[-1]) if names else {"version": None, "buckets": {}}

    def current(self) -> str | None:
        return self.manifest()["version"]

    def versions(self) -> list[str]:
        """Versions in the order in which they were first published."""
        return list(dict.fromkeys(self._read(n)["version"] for n in self._manifests()))

    def _publish(self, manifest: dict) -> None:
        names = self._manifests()
        number = int(names[-1].split("-")[0]) + 1 if names else 1
        aside = self._path(f"{self.root}/_versions/_{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.rename(aside, self._path(f"{self.root}/_versions/{number:012d}-{manifest['version']}.json")):
            raise OSError(f"cannot publish {manifest['version']}")

    def point(self, version: str) -> None:
        """Make an earlier version the current one, by publishing its manifest again."""
        found = [m for m in map(self._read, self._manifests()) if m["version"] == version]
        if not found:
            raise LookupError(version)
        self._publish(found[-1])

    # ---- rows

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(BUCKETS)).cast("int") if self.key else F.lit(0)

    def buckets_of(self, keys: DataFrame, key: str | None = None) -> list[int]:
        """The buckets, BUCKETS at most, that rows with these keys are in."""
        return sorted(r[0] for r in keys.select(self.bucket(key).alias("b")).distinct().collect())

    def load(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The current rows, or those in some buckets; an empty table where there are none."""
        held = self.manifest()["buckets"]
        folders = [f for b, f in held.items() if buckets is None or int(b) in set(buckets)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{f}" for f in sorted(set(folders))))

    def commit(self, rows: DataFrame, buckets: Iterable[int] | None = None) -> str:
        """Replace the table, or with ``buckets`` those of it, by ``rows``. Whoever reads before it commits
        does both within ``locked``."""
        with self.locked():
            version = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
            now = {} if buckets is None else {b: f for b, f in self.manifest()["buckets"].items() if int(b) not in set(buckets)}
            dealt = rows.withColumn(_BUCKET, self.bucket())
            # a bucket with very many rows is written by several tasks
            (dealt.hint("rebalance", _BUCKET) if self.key else dealt).write.partitionBy(_BUCKET).parquet(f"{self.root}/{version}")
            for status in self.fs.listStatus(self._path(f"{self.root}/{version}")):
                name = status.getPath().getName()
                if name.startswith(f"{_BUCKET}="):
                    now[name.split("=")[1]] = f"{version}/{name}"
            self._publish({"version": version, "buckets": now})
        return version

    # ---- one writer

    @contextmanager
    def locked(self) -> Iterator[None]:
        """Held by one writer at a time; within it, ``commit`` takes no further lock."""
        if getattr(self, "_held", False):
            yield
            return
        lock, until = self._path(f"{self.root}/_lock"), time.time() + self.lock_seconds
        while not self.fs.createNewFile(lock):
            if self._expired(lock):
                continue
            if time.time() > until:
                raise TimeoutError(f"{lock} is held")
            time.sleep(0.1)
        self._held, stop = True, threading.Event()
        renewal = threading.Thread(target=self._renew, args=(lock, stop), daemon=True)
        renewal.start()
        try:
            yield
        finally:
            stop.set()
            renewal.join()
            self._held = False
            self.fs.delete(lock, False)

    def _renew(self, lock, stop: threading.Event) -> None:
        while not stop.wait(self.lease_seconds / 3):
            self.fs.setTimes(lock, int(time.time() * 1000), -1)

    def _expired(self, lock) -> bool:
        """Whether the lock's lease ran out; then it is moved away, which one of several waiting writers can do."""
        try:
            if time.time() - self.fs.getFileStatus(lock).getModificationTime() / 1000 <= self.lease_seconds:
                return False
            aside = self._path(f"{self.root}/_expired-{uuid.uuid4().hex}")
            return bool(self.fs.rename(lock, aside)) and bool(self.fs.delete(aside, False))
        except Exception:  # the lock went meanwhile
            return True


def export_json(rows: DataFrame, path: str, by: str = "bid_id") -> None:
    """One folder of JSON lines for each bid."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def write_json(spark: SparkSession, path: str, payload: object) -> None:
    """One UTF-8 file, indented by two, with a newline at its end; written aside and moved into place."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at, aside = jvm.Path(path), jvm.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(aside, True)
    out.write(bytearray((json.dumps(payload, indent=2, ensure_ascii=False, default=str) + "\n").encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"cannot write {path}")
