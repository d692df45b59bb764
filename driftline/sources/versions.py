"""Tables whose content changes in one step (K6-K8): data folders and a numbered manifest that names the present ones.

A change writes its new folders first and then one small manifest file with the next number, by a rename that
fails if the number is taken. Readers use the newest manifest, so they see the table before the change or after
it, whole, wherever a writer is lost; two writers cannot both take a number. Properties (a forced drift, say)
stand in the manifest too and change in the same step. Folders that no manifest names any more are removed by
``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer changed the table first."""


@dataclass(frozen=True)
class Manifest:
    """``folders``: part of the table (a day, or the empty text) -> folders below the root that hold it."""

    number: int = 0
    folders: Mapping[str, list[str]] = field(default_factory=dict)
    properties: Mapping[str, object] = field(default_factory=dict)
    schema: str | None = None


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.root}/{name}")
        self._fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path("_manifest")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> Manifest:
        numbers = self._numbers()
        if not numbers:
            return Manifest()
        return Manifest(number=numbers[-1], **json.loads(self._text(f"_manifest/{numbers[-1]}")))

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, base: Manifest, folders: Mapping[str, list[str]], properties: Mapping[str, object], schema: str | None) -> Manifest:
        """The one step: manifest ``base.number`` + 1, or ``Conflict`` if somebody has made it."""
        made = Manifest(base.number + 1, folders, properties, schema)
        draft = self._path(f"_draft/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"folders": dict(folders), "properties": dict(properties), "schema": schema}).encode()))
        out.close()
        target = self._path(f"_manifest/{made.number}")
        self._fs.mkdirs(target.getParent())
        # the source is a file and so must be a target that exists: the rename fails then
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"{self.root}: version {made.number} is taken")
        return made

    def write(self, df: DataFrame) -> str:
        """Write a folder that no manifest names yet."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def read(self, manifest: Manifest | None = None, part: str | None = None) -> DataFrame:
        m = manifest or self.manifest()
        if m.schema is None:
            raise ValueError(f"{self.root} holds no version")
        schema = T.StructType.fromJson(json.loads(m.schema))
        names = [n for p, some in m.folders.items() if part is None or p == part for n in some]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names])

    def replace(self, df: DataFrame, properties: Mapping[str, object] | None = None) -> Manifest:
        """K6 + K7: the table becomes ``df``; properties of the old content end with it."""
        base = self.manifest()
        return self.commit(base, {"": [self.write(df)]}, properties or {}, df.schema.json())

    def append_days(self, df: DataFrame, day: str) -> Manifest:
        """Add rows, each day of the date column ``day`` as a part of its own."""
        base, name = self.manifest(), f"data-{uuid.uuid4().hex}"
        df.withColumn("_part", F.coalesce(F.col(day).cast("string"), F.lit("none"))).write.partitionBy("_part").parquet(f"{self.root}/{name}")
        folders = {p: list(f) for p, f in base.folders.items()}
        for status in self._fs.listStatus(self._path(name)):  # one folder per day
            at = status.getPath().getName()
            if at.startswith("_part="):
                folders.setdefault(at[6:], []).append(f"{name}/{at}")
        return self.commit(base, folders, base.properties, base.schema or df.schema.json())

    def purge_before(self, ts: str, cutoff: Column) -> Manifest:
        """K8: drop the rows older than the literal ``cutoff``: older days by name, the cutoff's own day rewritten."""
        edge = self.spark.range(1).select(F.to_date(cutoff).cast("string").alias("day")).first()["day"]
        base = self.manifest()
        if edge is None or base.schema is None:
            return base
        folders = {p: list(f) for p, f in base.folders.items() if p == "none" or p >= edge}
        if edge in folders:
            folders[edge] = [self.write(self.read(base, edge).filter(F.col(ts) >= cutoff))]
        return self.commit(base, folders, base.properties, base.schema)

    def set_property(self, name: str, value: object | None) -> Manifest:
        base = self.manifest()
        kept = {k: v for k, v in base.properties.items() if k != name}
        return self.commit(base, base.folders, kept if value is None else {**kept, name: value}, base.schema)

    def vacuum(self, keep: int = 1, older_than_hours: float = 24) -> list[str]:
        """Remove all manifests but the newest ``keep`` and the old folders that none of those names.

        A folder that a running change has written is not named yet, so only folders of some age are removed.
        """
        numbers = self._numbers()
        kept = [json.loads(self._text(f"_manifest/{n}")) for n in numbers[-keep:]]
        named = {f.split("/")[0] for m in kept for some in m["folders"].values() for f in some}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"_manifest/{n}"), False)
        latest = (time.time() - older_than_hours * 3600) * 1000
        found = self._fs.listStatus(self._path("_manifest").getParent()) if numbers else []
        gone = [s.getPath().getName() for s in found if s.getModificationTime() <= latest]
        gone = [g for g in gone if g.startswith("data-") and g not in named]
        for g in gone:
            self._fs.delete(self._path(g), True)
        return gone
