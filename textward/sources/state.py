"""State tables: their schemas, and keyed updates of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "nonces": ("nonce string, uses int, expires_at double", ["nonce"]),
    "events": ("session_id string, kind string, ts double", ["session_id", "kind", "ts"]),
    "risk": ("session_id string, risk double, last_update double, flagged boolean, expires_at double", ["session_id"]),
    "revocations": ("subject string, revoked_at double, expires_at double", ["subject"]),
    "provenance": ("document_id string, content_hash string, source_id string, trust string, decision string, risk_score double, recorded_at timestamp", ["document_id"]),
}


class Conflict(Exception):
    """Another writer has committed a version in between."""


class Tables:
    """Tables under a root folder. An update writes a new version of the whole table and then commits it with a file
    named by its number, which only one writer can create (where the file system creates files exclusively): a reader
    sees the old or the new version, a lost executor costs a task, and a writer that comes second starts over from the
    first one's version. Versions that were never committed stay behind unseen."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _log(self, name: str) -> list[tuple[int, str]]:
        """(number, folder) of the commits; the folder of a commit that was cut short is ''."""
        p, fs = self._fs(f"{self.root}/{name}/_log")
        if not fs.exists(p):
            return []
        found = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().isdigit())
        return [(int(n), self._folder(f"{self.root}/{name}/_log/{n}")) for n in found[-3:]]

    def _folder(self, path: str) -> str:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def version(self, name: str) -> int:
        """The number of the last commit, 0 if there is none."""
        return max((n for n, _ in self._log(name)), default=0)

    def read(self, name: str) -> DataFrame:
        schema, found = SCHEMAS[name][0], [f for _, f in self._log(name) if f]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{found[-1]}") if found else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, after: int | None = None) -> None:
        """Commit rows as the version behind `after` (the last one); Conflict if there is one already."""
        number = (self.version(name) if after is None else after) + 1
        folder = f"{number:09d}-{uuid.uuid4().hex}"
        rows.select(*[c.split()[0] for c in SCHEMAS[name][0].split(", ")]).write.parquet(f"{self.root}/{name}/{folder}")
        p, fs = self._fs(f"{self.root}/{name}/_log/{number:09d}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                raise Conflict(f"{name} has a version {number}") from e
            raise
        out.write(folder.encode())
        out.close()

    def _change(self, name: str, change: Callable[[DataFrame], DataFrame], tries: int = 8) -> None:
        for left in reversed(range(tries)):
            after = self.version(name)
            try:
                return self.write(name, change(self.read(name)), after)
            except Conflict:
                if not left:
                    raise

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Put rows in the place of those with their keys; of rows with one key the greatest by its other columns counts."""
        columns, keys = [c.split()[0] for c in SCHEMAS[name][0].split(", ")], SCHEMAS[name][1]
        rest = [c for c in columns if c not in keys]
        new = rows.select(*keys).distinct()
        if rest:
            new = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_rest")).select(*keys, "_rest.*")
        self._change(name, lambda old: old.join(new.select(*keys), keys, "left_anti").unionByName(new))

    def sweep(self, name: str, now: float) -> None:
        """Leave out expired rows."""
        self._change(name, lambda old: old.where(F.col("expires_at") > now))
