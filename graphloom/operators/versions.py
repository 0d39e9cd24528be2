"""A graph with numbered versions: a base and a log of changes.

Under a path lie bases (Parquet, a folder for each predicate) and changes (the
rows of one insert or delete each), and a log with a file for each version that
names what it added. A version counts once its log file is there; the file is
made only if it isn't there yet, so of two writers of one version one fails and
changes nothing. An insert writes its own rows only and reads nothing; a reader
joins the changes since the last base against the base's layers, where the last change
of a triple holds. compact() writes a new base for the readers to come; versions
before it can still be read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import small
from .storage import file_system, names
from .store import CHANGE, TRIPLE, GraphStore


@dataclass
class GraphLog:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, store: GraphStore) -> GraphLog:
        """A log whose version 0 is the store."""
        log = cls(spark, path)
        store.save(f"{path}/base-0")
        log._commit(0, "base", "base-0")
        return log

    def entries(self) -> list[dict]:
        """version, kind (base or change) and folder, a row for each version and each base."""
        files = [name for name, folder in names(self.spark, f"{self.path}/log") if not folder and name.endswith(".json")]
        if not files:
            raise FileNotFoundError(f"no graph log at {self.path}")
        rows = self.spark.read.schema("version bigint, kind string, folder string").json([f"{self.path}/log/{f}" for f in files]).collect()  # a row for each version
        return sorted((r.asDict() for r in rows), key=lambda r: (r["version"], r["kind"] == "base"))

    def version(self) -> int:
        return self.entries()[-1]["version"]

    def insert(self, triples: Iterable[tuple[str, str, str]] | DataFrame) -> int:
        """The version after the triples were put in."""
        return self._write(triples, True)

    def delete(self, triples: Iterable[tuple[str, str, str]] | DataFrame) -> int:
        return self._write(triples, False)

    def _write(self, triples: Iterable[tuple[str, str, str]] | DataFrame, there: bool) -> int:
        version = self.version() + 1
        rows = triples if isinstance(triples, DataFrame) else self.spark.createDataFrame(list(triples), "s string, p string, o string")
        rows.select(*TRIPLE).distinct().withColumn("there", F.lit(there)).write.mode("errorifexists").parquet(f"{self.path}/change-{version}")
        self._commit(version, "change", f"change-{version}")
        return version

    def _commit(self, version: int, kind: str, folder: str) -> None:
        files, place = file_system(self.spark, f"{self.path}/log/{version:012d}-{kind}.json")
        out = files.create(place, False)  # fails if it is there
        out.write(bytearray(json.dumps({"version": version, "kind": kind, "folder": folder}).encode()))
        out.close()

    def at(self, version: int | None = None) -> GraphStore:
        """The graph at a version, the last one by default."""
        entries = self.entries()
        version = entries[-1]["version"] if version is None else version
        if not 0 <= version <= entries[-1]["version"]:
            raise ValueError(f"no version {version}")
        base = max((e for e in entries if e["kind"] == "base" and e["version"] <= version), key=lambda e: e["version"])
        store = GraphStore.load(self.spark, f"{self.path}/{base['folder']}")
        since = [e for e in entries if e["kind"] == "change" and base["version"] < e["version"] <= version]
        if not since:
            return store
        rows = [self.spark.read.schema(CHANGE).parquet(f"{self.path}/{e['folder']}").withColumn("version", F.lit(e["version"])) for e in since]
        every = rows[0]
        for more in rows[1:]:
            every = every.unionAll(more)
        store.changes = small(every.groupBy(*TRIPLE).agg(F.max_by("there", "version").alias("there")))
        return store

    def compact(self) -> int:
        """Writes a base of the last version, which it returns; later reads start from it."""
        version = self.version()
        if any(e["kind"] == "base" and e["version"] == version for e in self.entries()):
            return version
        self.at(version).save(f"{self.path}/base-{version}")
        self._commit(version, "base", f"base-{version}")
        return version
