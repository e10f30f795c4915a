"""Tables of runs that become visible all at once.

A run writes its tables under a folder of its own, one per attempt. One manifest row, written as one file
in one commit, then names the attempt and its tables; readers go by the manifest only. So a run that is
killed between two writes leaves nothing that can be seen, and a run that is repeated under its
run_id takes the place of the earlier one. Folders that the manifest does not name can be expired.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logveil.schema import MANIFEST
from logveil.sources import writers

AUDIT = "audit"


@dataclass
class Attempt:
    """One try of a run: tables are written under `folder` and named by `commit`."""

    folder: str
    manifest: str
    run_id: str
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    tables: list[str] = field(default_factory=list)

    def path(self, table: str) -> str:
        return f"{self.folder}/{self.run_id}/{self.name}/{table}"

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Write a table and give back what was written, so that nothing is computed twice."""
        rows.write.parquet(self.path(table))
        self.tables.append(table)
        return rows.sparkSession.read.schema(rows.schema).parquet(self.path(table))

    def write_report(self, mode: str, summary: DataFrame, children: dict[str, DataFrame], at: datetime) -> None:
        """The tables of a report, and its nested documents made from what was written."""
        summary = self.write(f"{mode}_summary", summary)
        rows = {name: self.write(f"{mode}_{name}", child) for name, child in children.items()}
        self.write(f"{mode}_documents", writers.report_documents(summary, rows, at))

    def commit(
        self,
        spark: SparkSession,
        start: datetime,
        end: datetime,
        finished: datetime,
        modes: list[tuple[str, str, str | None]],
    ) -> None:
        """Make the attempt visible: modes are (mode, status, error)."""
        row = (self.run_id, self.name, sorted(self.tables), modes, start, end, finished)
        spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(self.manifest)


@dataclass(frozen=True)
class RunStore:
    """A folder of runs; run_ids become folder names."""

    folder: str

    def begin(self, run_id: str) -> Attempt:
        return Attempt(f"{self.folder.rstrip('/')}/runs", f"{self.folder.rstrip('/')}/manifest", run_id)

    def visible(self, spark: SparkSession) -> DataFrame:
        """The manifest rows that count: of each run_id the one that finished last."""
        try:
            rows = spark.read.schema(MANIFEST).parquet(f"{self.folder.rstrip('/')}/manifest")
            rows.limit(1).collect()
        except Exception:  # noqa: BLE001 - no manifest means no runs
            rows = spark.createDataFrame([], MANIFEST)
        last = Window.partitionBy("run_id").orderBy(F.desc("finished_ts"), F.desc("attempt"))
        return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        """(run_id, the table's columns) of all visible runs that wrote it; None if none did."""
        named = self.visible(spark).where(F.array_contains("tables", table)).select("run_id", "attempt").collect()
        if not named:
            return None
        paths = [f"{self.folder.rstrip('/')}/runs/{r['run_id']}/{r['attempt']}/{table}" for r in named]
        place = F.col("_metadata.file_path")
        run = F.url_decode(F.regexp_extract(place, f".*/runs/([^/]+)/[^/]+/{table}/", 1)).alias("run_id")
        if table == AUDIT:  # events of several runs have no common folder to take their names from
            rows = spark.read.json([f"{p}/event=*" for p in paths])
            return rows.select(run, F.regexp_extract(place, "/event=([^/]+)/", 1).alias("event"), "*")
        return spark.read.option("mergeSchema", True).parquet(*paths).select(run, "*")

    def ledger(self, spark: SparkSession) -> DataFrame:
        """The run ledger: one row per visible run and mode."""
        return self.visible(spark).select(
            "run_id", "start_ts", "end_ts", "finished_ts", F.inline("modes")
        ).select("run_id", "start_ts", "end_ts", "finished_ts", "mode", "status")

    def expire(self, spark: SparkSession, before: datetime) -> int:
        """Delete attempts that no visible row names and that were last written to before that time.

        Folders are listed and removed one by one on the driver; their number follows the number of runs.
        """
        kept = {(r["run_id"], r["attempt"]) for r in self.visible(spark).select("run_id", "attempt").collect()}
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/runs")
        fs, gone = root.getFileSystem(conf), 0
        if not fs.exists(root):
            return 0
        for run in fs.listStatus(root):
            for attempt in fs.listStatus(run.getPath()):
                name = (run.getPath().getName(), attempt.getPath().getName())
                if name not in kept and attempt.getModificationTime() < before.timestamp() * 1000:
                    gone += bool(fs.delete(attempt.getPath(), True))
        return gone
