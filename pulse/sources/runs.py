"""Remembered runs: versioned result frames with a manifest that is written last.

A run's frames are written to a folder of their own attempt; only then one small manifest (run, time, frames with row
counts, and what the caller wants remembered, such as filters and metrics) is put in place by a rename. A run that
dies half way has no manifest and is never seen; running it again writes a new attempt and replaces the manifest,
while readers of the old one still find its files. Runs are listed from their manifests, one small file each.

    base/data/<run>/<attempt>/<frame>/part-*.parquet
    base/manifests/<run>.json
"""

from __future__ import annotations

import dataclasses
import json
import re
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclasses.dataclass(frozen=True)
class Run:
    run_id: str
    run_ts: str
    attempt: str
    frames: dict
    info: dict


class RunStore:
    """Runs below ``base``, a folder that driver and executors share (any Hadoop URI)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop, self.spark.sparkContext._jsc.hadoopConfiguration()

    def write(self, run_id: str, run_ts: datetime, frames: dict[str, DataFrame], info: dict | None = None) -> Run:
        """Write all frames, then the manifest. The same ``run_id`` again replaces the run."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id) or run_id.startswith("."):
            raise ValueError(f"run id {run_id!r} must be a file name of letters, digits, _ . -")
        attempt = uuid.uuid4().hex
        kept = {}
        for name, df in frames.items():
            path = f"data/{run_id}/{attempt}/{name}"
            df.write.parquet(f"{self.base}/{path}")
            back = self.spark.read.schema(df.schema).parquet(f"{self.base}/{path}")
            kept[name] = {"path": path, "rows": back.count(), "schema": json.loads(df.schema.json())}
        run = Run(run_id, run_ts.isoformat(timespec="microseconds"), attempt, kept, info or {})
        self._publish(run)
        return run

    def _publish(self, run: Run) -> None:
        hadoop, conf = self._hadoop()
        folder = f"{self.base}/manifests"
        draft, final = (hadoop.fs.Path(f"{folder}/{n}") for n in (f".{run.run_id}.{run.attempt}", f"{run.run_id}.json"))
        fs = final.getFileSystem(conf)
        fs.mkdirs(hadoop.fs.Path(folder))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(dataclasses.asdict(run)).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
        over[0] = hadoop.fs.Options.Rename.OVERWRITE
        hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(final), over)

    def runs(self, as_of: datetime | None = None) -> list[Run]:
        """Complete runs, latest first; with ``as_of`` only those of that time or before."""
        hadoop, conf = self._hadoop()
        folder = hadoop.fs.Path(f"{self.base}/manifests")
        if not folder.getFileSystem(conf).exists(folder):
            return []
        texts = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.base}/manifests", wholetext=True).collect()
        found = [Run(**json.loads(r["value"])) for r in texts]
        if as_of is not None:
            found = [r for r in found if r.run_ts <= as_of.isoformat(timespec="microseconds")]
        return sorted(found, key=lambda r: (r.run_ts, r.run_id), reverse=True)

    def latest(self, n: int = 2, as_of: datetime | None = None) -> list[Run]:
        return self.runs(as_of)[:n]

    def frame(self, run: Run, name: str) -> DataFrame:
        kept = run.frames[name]
        return self.spark.read.schema(StructType.fromJson(kept["schema"])).parquet(f"{self.base}/{kept['path']}")
