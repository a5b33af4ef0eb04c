"""An append-only store of keyed tables: every commit adds small files, reads merge them, compaction rewrites what has piled up.

    <path>/commits/00000007.json     the whole state after commit 7: which files are read, and the phases that are done
    <path>/<table>/batch=<id>/...    Parquet, partitioned by the table's own partition columns and a bucket of its key

A batch counts only once a commit names its folders. The commit is a file that is written aside and renamed to the next
number, which fails where another writer has taken it; the writer then reads the new state and tries again. A crash
before the rename leaves folders that nobody reads. Executors write through Spark, so a lost one costs a task's retry.

A commit holds no rows, only a line for each folder read: live batches times partitions and buckets.
"""
from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmill.sources.store import BARS, CATALOG, coerced

KEYED = [T.StructField(c, T.StringType()) for c in ("venue", "freq", "key")]
DONE = T.StructType([*KEYED, T.StructField("n_bars", T.LongType())])
LETTERS = T.StructType([*KEYED, T.StructField("error", T.StringType()), T.StructField("attempts", T.LongType())])
TAGS = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("tags", T.StringType())])


@dataclass(frozen=True)
class Table:
    """Columns, those that tell rows apart, those that folders are named by, and the one that is bucketed."""

    schema: T.StructType
    keys: tuple[str, ...]
    folders: tuple[str, ...]
    bucketed: str = "key"


TABLES = {
    "bars": Table(BARS, ("venue", "freq", "key", "ts"), ("venue", "freq")),
    "catalog": Table(CATALOG, ("venue", "key"), ("venue",)),
    "done": Table(DONE, ("venue", "freq", "key"), ("venue", "freq")),
    "dead_letters": Table(LETTERS, ("venue", "freq", "key"), ("venue", "freq")),
    "tags": Table(TAGS, ("event_id",), (), "event_id"),
}


class Conflict(RuntimeError):
    """Another writer has compacted the same folders."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; executors can't read the driver's folders")
        base = "file://" + tempfile.mkdtemp(prefix="store-")
    return base.rstrip("/")


class Store:
    """The tables under a path, which driver and executors share. `buckets` counts for a new store; an old one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, tables: dict[str, Table] = TABLES) -> None:
        self.spark, self.tables, self._buckets = spark, tables, buckets
        jvm = spark._jvm
        given = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = given.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._fs.makeQualified(given).toString().rstrip("/")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def state(self) -> dict:
        """The last commit; an empty state before the first."""
        folder = self._at("commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(m[1]) for n in names if (m := re.fullmatch(r"([0-9]{8})\.json", n))]
        if not numbers:
            return {"version": 0, "buckets": self._buckets, "files": {}, "phases": []}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{max(numbers):08d}.json", wholetext=True).first()[0])

    def _publish(self, state: dict) -> bool:
        """Write the state under its number; False where that number is taken."""
        jvm = self.spark._jvm
        aside, final = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{state['version']:08d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, final, none)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _write(self, name: str, df: DataFrame, buckets: int) -> list[list[str]]:
        """Write a batch, a row for each key, and list its (batch, partition) folders."""
        table = self.tables[name]
        rows = coerced(df, table.schema).select(*table.schema.names)
        for c in table.keys:  # a row without its key can't be found again
            rows = rows.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
        order = [F.col(c).asc_nulls_last() for c in table.schema.names if c not in table.keys]
        if order:
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*table.keys).orderBy(*order))).filter("_n = 1").drop("_n")
        else:
            rows = rows.dropDuplicates(list(table.keys))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(table.bucketed), F.lit(buckets)).cast("int"))
        by = [*table.folders, "bucket"]
        batch = f"batch={uuid.uuid4().hex}"
        # rebalance: a file or few for each folder, and more tasks for a folder that holds much
        rows.hint("rebalance", *map(F.col, by)).write.partitionBy(*by).parquet(f"{self.path}/{name}/{batch}")
        written = self.spark.read.schema(self._schema(table)).parquet(f"{self.path}/{name}/{batch}").select(F.regexp_extract("_metadata.file_path", f"{batch}/(.*)/[^/]*$", 1).alias("f")).distinct()
        return sorted([batch, unquote(r.f)] for r in written.collect())

    def _schema(self, table: Table) -> T.StructType:
        inside = [f for f in table.schema if f.name not in table.folders]
        return T.StructType([*inside, *(T.StructField(c, T.StringType()) for c in ("batch", *table.folders)), T.StructField("bucket", T.IntegerType())])

    def _files(self, name: str, folders: list[list]) -> DataFrame:
        table = self.tables[name]
        paths = [f"{self.path}/{name}/{batch}/{part}" for batch, part, _ in folders]
        return self.spark.read.schema(self._schema(table)).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _merged(self, name: str, folders: list[list]) -> DataFrame:
        """Rows of folders (batch, partition, order), of equal keys that of the latest batch."""
        table = self.tables[name]
        order = self.spark.createDataFrame(sorted({(b.removeprefix("batch="), o) for b, _, o in folders}), "batch string, _order long")
        rows = self._files(name, folders).join(F.broadcast(order), "batch")  # a row for each live batch
        w = Window.partitionBy(*table.keys).orderBy(F.col("_order").desc())
        return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*table.schema.names)

    def read(self, name: str) -> DataFrame:
        """The table as of now. Partitions that one batch alone has written are read without a shuffle, the others merged."""
        table, by_part = self.tables[name], defaultdict(list)
        for folder in self.state()["files"].get(name, []):
            by_part[folder[1]].append(folder)
        alone = [x[0] for x in by_part.values() if len(x) == 1]
        piled = [f for x in by_part.values() if len(x) > 1 for f in x]
        parts = ([self._files(name, alone).select(*table.schema.names)] if alone else []) + ([self._merged(name, piled)] if piled else [])
        if not parts:
            return self.spark.createDataFrame([], table.schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def commit(self, tables: dict[str, DataFrame], phase: str | None = None) -> int:
        """Add rows to tables, all of them or none, and note the phase as done; returns the commit's number.

        New rows replace those with equal keys. Within a batch the smallest of equal keys stays, nulls last. Rows with a
        null or empty key column aren't stored. Columns are those of the table: others are left out, missing ones null.
        """
        buckets = self.state()["buckets"]
        batches = {name: self._write(name, df, buckets) for name, df in tables.items()}
        while True:
            state = self.state()
            if state["buckets"] != buckets:
                raise Conflict("the store was begun with another number of buckets meanwhile")
            state["version"] += 1
            for name, folders in batches.items():
                state["files"].setdefault(name, []).extend([b, p, state["version"]] for b, p in folders)
            if phase and phase not in state["phases"]:
                state["phases"].append(phase)
            if self._publish(state):
                return state["version"]

    def compact(self, name: str, most: int = 1) -> int:
        """Merge partitions of over `most` batches into one each; returns how many. Commits made meanwhile stay on top."""
        state, by_part = self.state(), defaultdict(list)
        for folder in state["files"].get(name, []):
            by_part[folder[1]].append(folder)
        piled = {p: x for p, x in by_part.items() if len(x) > most}
        if not piled:
            return 0
        old = [f for x in piled.values() for f in x]
        new = self._write(name, self._merged(name, old), state["buckets"])
        new = [[b, p, max(o for _, _, o in piled[p])] for b, p in new]
        while True:
            state = self.state()
            live = state["files"].get(name, [])
            if any(f not in live for f in old):
                raise Conflict(f"{name} was compacted by another writer")
            state["files"][name] = [f for f in live if f not in old] + new
            state["version"] += 1
            if self._publish(state):
                return len(piled)


Phase = Callable[[Store], dict[str, DataFrame]]


def run_phases(store: Store, phases: dict[str, Phase], only: str | None = None, since: str | None = None) -> list[str]:
    """Run phases in order, each committed with its name, and return the names of those run.

    Phases that a commit names are skipped, so that a run after a crash resumes at the phase that failed. `only` or
    `since` names a phase to run again, by itself or with all that follow, done or not.
    """
    names = list(phases)
    for given in (only, since):
        if given is not None and given not in phases:
            raise ValueError(f"no phase {given!r}; there are {', '.join(names)}")
    chosen = [only] if only else names[names.index(since) :] if since else [n for n in names if n not in store.state()["phases"]]
    for name in chosen:
        store.commit(phases[name](store), name)
    return chosen
