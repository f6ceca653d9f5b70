"""Sinks of audit events, and files of binary payloads."""

from __future__ import annotations

import json
import os
from contextlib import closing
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_files(events: DataFrame, path: str, *, max_records: int = 1_000_000) -> None:
    """Append JSON lines; each task rotates its files by number of records."""
    events.write.mode("append").option("maxRecordsPerFile", max_records).json(path)


class RotatingFile(RotatingFileHandler):
    """A file of lines: before a line would take it over max_bytes, the file moves to .1, .1 to .2 and so on, and the one past backups goes.

    {pid} in the path is the process's id. With fsync each line is on disk before the next.
    """

    def __init__(self, path: str, *, max_bytes: int = 64 << 20, backups: int = 5, fsync: bool = False) -> None:
        if max_bytes <= 0 or backups < 0:
            raise ValueError("max_bytes is positive, backups not negative")
        path = path.replace("{pid}", str(os.getpid()))
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        super().__init__(path, maxBytes=max_bytes, backupCount=backups, encoding="utf-8")
        self.fsync = fsync

    def doRollover(self) -> None:  # noqa: N802 - named by the standard library
        if self.backupCount:
            return super().doRollover()
        self.stream.seek(0)  # no backups: the file starts anew
        self.stream.truncate()

    def line(self, text: str) -> None:
        # the length counts in bytes, not in characters
        if self.stream is None:
            self.stream = self._open()
        self.stream.seek(0, os.SEEK_END)
        if self.stream.tell() + len(text.encode()) + 1 > self.maxBytes and self.stream.tell():
            self.doRollover()
        self.stream.write(text + "\n")
        self.stream.flush()
        if self.fsync:
            os.fsync(self.stream.fileno())


def to_rotating(events: DataFrame, path: str, **options) -> None:
    """Append JSON lines to files that rotate by size, one for each worker process ({pid} in the path); a task that is
    run again appends its lines again, as an audit trail may hold an event twice but not miss it."""
    if "{pid}" not in path:
        raise ValueError("workers would write into one file: put {pid} into the path")

    def write(rows) -> None:
        with closing(RotatingFile(path, **options)) as out:
            for row in rows:
                out.line(row[0])

    events.select(F.to_json(F.struct("*"))).foreachPartition(write)


def to_stdout(events: DataFrame) -> None:
    """Print events of a small batch, one JSON line each (a sink for development)."""
    for line in events.toJSON().toLocalIterator():
        print(line)


def to_logger(events: DataFrame, logger) -> None:
    """Hand the events of a micro-batch to a logger of the standard library, with audit_event and audit_data."""
    for r in events.toLocalIterator():
        logger.info(r["event"], extra={"audit_event": r["event"], "audit_data": json.loads(r["data"])})


def retain(events: DataFrame, most: int) -> DataFrame:
    """About the newest `most` events: those from the time on that splits them off."""
    n = events.count()
    if n <= most:
        return events
    micros = F.unix_micros("ts")
    cut = events.agg(F.percentile_approx(micros, (n - most) / n, 10_000).alias("c")).first().c
    return events.where(micros >= cut)


def payloads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, bytes) of the files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content", F.col("length").alias("bytes"))
