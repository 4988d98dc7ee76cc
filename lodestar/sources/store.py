"""Keyed storage as an append-only change table: the latest row of a key counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "namespace string, id string, values array<float>, norm double, metadata string, seq long, deleted boolean"


class Storage:
    """Files of one index under any path Spark can write: ``changes/seq=N`` per write, ``snapshot/seq=N`` and a ``CURRENT`` pointer.

    One writer at a time. Numbers are handed out by the highest seen; a write is one Spark job and
    its folder appears with the job's commit, so a failed write leaves nothing readable.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self.fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._hadoop(f"{self.path}/{name}")

    def numbers(self, kind: str) -> list[int]:
        """Numbers of finished writes of a kind."""
        root = self._p(kind)
        if not self.fs.exists(root):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(root)]
        return sorted(int(n[4:]) for n in found if n.startswith("seq=") and n[4:].isdigit() and self.fs.exists(self._p(f"{kind}/{n}/_SUCCESS")))

    def read_text(self, name: str) -> str | None:
        p = self._p(name)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Write beside and move over the old file in one step, so readers see the old or the new text."""
        tmp, p = self._p(f"{name}.{uuid.uuid4().hex}"), self._p(name)
        out = self.fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        how = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(self.fs.getUri(), sc._jsc.hadoopConfiguration()).rename(tmp, p, how)

    def current(self) -> dict:
        """What the last snapshot wrote down; nothing where that is lost or damaged, as all of it can be found again."""
        try:
            found = json.loads(self.read_text("CURRENT") or "{}")
        except ValueError:
            found = {}
        return found if isinstance(found, dict) else {}

    def at(self) -> int:
        """The number of the newest whole snapshot, 0 without any; damaged and stray folders do not count."""
        return max(self.numbers("snapshot"), default=0)

    def oldest(self) -> int:
        """The state from which all later changes are still in the log."""
        kept = self.numbers("changes")
        return min(kept) - 1 if kept else self.at()

    def next_seq(self) -> int:
        return max([int(self.current().get("high", 0)), *self.numbers("changes"), *self.numbers("snapshot")]) + 1

    def append(self, rows: DataFrame, seq: int | None = None) -> int:
        """One write: rows ``(namespace, id, values, norm, metadata, deleted)``; the last of an id in ``pos`` order counts. A number given is that of a write to be replaced."""
        seq = seq or self.next_seq()
        if "pos" in rows.columns:
            last = Window.partitionBy("namespace", "id").orderBy(F.desc("pos"))
            rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1")
        cols = ("namespace", "id", "values", "norm", "metadata", "deleted")
        rows.select(*cols).write.mode("overwrite").parquet(f"{self.path}/changes/seq={seq}")
        return seq

    def log(self, after: int = 0) -> DataFrame:
        """Changes numbered above ``after``; older folders are not opened."""
        parts = [n for n in self.numbers("changes") if n > after]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        schema = ", ".join(c for c in SCHEMA.split(", ") if not c.startswith("seq"))
        read = self.spark.read.schema(f"{schema}, seq long").option("basePath", f"{self.path}/changes")
        return read.parquet(*[f"{self.path}/changes/seq={n}" for n in parts]).select(*[c.split()[0] for c in SCHEMA.split(", ")])

    def live(self, keep_deleted: bool = False) -> DataFrame:
        """Snapshot and later changes, the latest row per key, without deleted ones.

        A snapshot has one row per key, so it is read as it is: only the keys of later changes are taken out of it,
        and only the changes are merged.
        """
        at = self.at()
        log, later = self.log(at), any(n > at for n in self.numbers("changes"))
        if not at:
            return latest(log, keep_deleted)
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/snapshot/seq={at}")
        if not later:
            return rows
        changed = latest(log.select("namespace", "id", "seq"), True, ()).select("namespace", "id")
        return rows.join(changed, ["namespace", "id"], "left_anti").unionByName(latest(log, keep_deleted))

    def snapshot(self) -> int:
        """Write the live rows down and point to them; numbers go on from the highest.

        The snapshot before and the changes since stay until the next one, for readers that still use them
        and in case the new one is lost.
        """
        numbers, before = self.numbers("changes"), self.at()
        if not numbers or max(numbers) <= before:
            return before
        seq = max(numbers)
        spaces = sorted({*self.current().get("namespaces", []), *(r["namespace"] for r in self.log(before).select("namespace").distinct().collect())})
        self.fs.delete(self._p(f"snapshot/seq={seq}"), True)  # what an interrupted try has left
        self.live().write.parquet(f"{self.path}/snapshot/seq={seq}")
        self.write_text("CURRENT", json.dumps({"seq": seq, "high": seq, "namespaces": spaces}))
        for kind, top in (("changes", before), ("snapshot", before - 1)):
            for n in self.numbers(kind):
                if n <= top:
                    self.fs.delete(self._p(f"{kind}/seq={n}"), True)
        return seq

    def compact(self, least: int = 1_000, share: float = 0.2) -> bool:
        """Take a snapshot if the changes since the last one are at least ``least`` rows and that share of the live rows."""
        changed = self.log(self.at()).count()
        if changed < least or changed < share * self.live().count():
            return False
        self.snapshot()
        return True


def latest(rows: DataFrame, keep_deleted: bool = False, cols: tuple[str, ...] = ("values", "norm", "metadata", "deleted")) -> DataFrame:
    """The row with the highest ``seq`` of each (namespace, id). ``max_by`` combines before the shuffle, so keys written often cost one row a task."""
    one = rows.groupBy("namespace", "id").agg(F.max_by(F.struct("seq", *cols), "seq").alias("r")).select("namespace", "id", "r.*")
    names = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] in one.columns]
    return one.select(*names) if keep_deleted or "deleted" not in cols else one.where("not deleted").select(*names)


def purgeable(rows: DataFrame, snapshots: Sequence[int]) -> DataFrame:
    """Markers of deleted records that every kept snapshot already covers."""
    return latest(rows, keep_deleted=True).where("deleted").where(F.col("seq") <= min(snapshots, default=0))


def page(rows: DataFrame, limit: int, prefix: str = "", after: str | None = None) -> DataFrame:
    """Ids in order, above the token ``after``, one more than ``limit`` to tell whether more follow."""
    found = rows.where(F.col("id").startswith(prefix)) if prefix else rows
    if after is not None:
        found = found.where(F.col("id") > after)
    return found.orderBy("id").limit(limit + 1)
