"""Keyed Parquet tables as a series of immutable snapshots.

A version is a small manifest that names the data folders that it is made of, by partition, and the last batch of each
writer. Data folders are never changed: a write puts new folders beside the old ones and then publishes a manifest of the
next number by a rename that fails where that number is taken. So a reader sees the version before or the one after,
a writer that dies between the two leaves only folders that no version names, and of two writers one tries again.
A batch that its writer has published already isn't written twice.

Only the partitions that new rows are in are merged and written; the others' folders are named again. A manifest has an
entry for each partition, so partitions are to be days, symbols and the like, not keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import Table, merge_ignore, merge_update

ATTEMPTS = 8


class Conflict(RuntimeError):
    """Another writer published the version first, again and again."""


class SnapshotTable(Table):
    """A ``Table`` whose versions are published as a whole; ``keep`` versions outlive a clean-up."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], partition_by: Sequence[str] = (), keep: int = 3):
        super().__init__(spark, path, keys, partition_by)
        self.keep = keep

    # Manifests

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _versions(self) -> list[int]:
        fs, _ = self._fs()
        folder = self._hadoop(f"{self.path}/versions")
        found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in found if n.startswith("v") and n.endswith(".json"))

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/v{version:012d}.json"

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest manifest, or that of ``version``; None for a table without one."""
        found = self._versions()
        if version is None:
            version = found[-1] if found else None
        if version is None or version not in found:
            return None
        fs, _ = self._fs()
        stream = fs.open(self._hadoop(self._name(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest's number was still free."""
        fs, _ = self._fs()
        staged = self._hadoop(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(fs.makeQualified(staged), fs.makeQualified(self._hadoop(self._name(manifest["version"]))), options)
        except Exception as e:
            fs.delete(staged, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    # Reading

    def exists(self) -> bool:
        return bool(self._versions())

    def _read(self, manifest: dict, parts: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{p}" for k, v in sorted(manifest["parts"].items()) if parts is None or k in parts for p in v]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that is still kept."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError(f"no version {version if version is not None else ''} of {self.path}")
        return self._read(manifest)

    # Writing

    def _folders(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write ``rows`` beside what is there; their folders by partition."""
        own = f"data/{uuid.uuid4().hex}"
        fs, _ = self._fs()
        if not self.partition_by:
            rows.write.parquet(f"{self.path}/{own}")
            return {"": [own]}
        marks = [f"_of_{c}" for c in self.partition_by]  # the columns themselves stay in the files
        marked = rows.withColumns({m: F.col(c).cast("string") for m, c in zip(marks, self.partition_by, strict=True)})
        marked.repartition(*marks).write.partitionBy(*marks).parquet(f"{self.path}/{own}")
        level = [own]
        for _ in marks:
            level = [f"{p}/{s.getPath().getName()}" for p in level for s in fs.listStatus(self._hadoop(f"{self.path}/{p}")) if s.isDirectory()]
        return {p.removeprefix(f"{own}/"): [p] for p in level}

    def _change(self, given: DataFrame, made: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None, adds: bool = False, of: DataFrame | None = None) -> bool:
        """Publish a version with the partitions of ``given`` made anew; False where the batch was published before.

        ``made(old, given)`` is the partitions' new rows, or with ``adds`` the rows to add to the old ones.
        """
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if batch and now and now["batches"].get(batch[0], -1) >= batch[1]:
                return False
            parts = dict(now["parts"]) if now else {}
            if now is None:
                fresh = self._folders(made(given.limit(0), given))
            else:
                touched = self._touched(given if of is None else of, parts)
                fresh = self._folders(made(self._read(now, touched), given))
                if not adds:
                    for part in touched:
                        del parts[part]
            for part, folders in fresh.items():
                parts[part] = parts.get(part, []) + folders
            batches = dict(now["batches"]) if now else {}
            if batch:
                batches[batch[0]] = batch[1]
            schema = json.loads(given.schema.json()) if now is None else now["schema"]
            if self._publish({"version": now["version"] + 1 if now else 0, "parts": parts, "batches": batches, "schema": schema}):
                return True
        raise Conflict(f"{self.path} changed under {ATTEMPTS} attempts")

    def _touched(self, given: DataFrame, parts: dict) -> list[str]:
        """The partitions that ``given`` has rows in, by the names that their folders have."""
        if not self.partition_by:
            return list(parts)
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        default = "__HIVE_DEFAULT_PARTITION__"
        values = given.select(*[F.col(c).cast("string").alias(c) for c in self.partition_by]).distinct().collect()  # partitions are few
        names = {"/".join(f"_of_{c}={escape(r[c]) if r[c] not in (None, '') else default}" for c in self.partition_by) for r in values}
        return [p for p in parts if p in names]

    def append(self, rows: DataFrame) -> None:
        self._change(rows, lambda old, new: new, None, adds=True)

    def rewrite(self, rows: DataFrame) -> None:
        """The table, or those partitions that ``rows`` are in, with ``rows`` instead; they may be made from it."""
        self._change(rows, lambda old, new: new.select(*old.columns), None)

    def replace(self, rows: DataFrame, where: dict[str, object]) -> None:
        """``rows`` instead of those of one partition, also where they are none."""
        mark = self.spark.createDataFrame([tuple(str(where[c]) for c in self.partition_by)], list(self.partition_by))
        given, path = self._staged(rows)
        try:
            self._change(given, lambda old, new: new.select(*old.columns), None, of=mark)
        finally:
            self._drop(path)

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Insert or update; returns the rows given. ``batch`` is a writer's name and the number of its batch."""
        given, path = self._staged(rows)
        try:
            self._change(given, lambda old, new: merge_update(old, new.select(*old.columns), self.keys), batch)
            return given.count()
        finally:
            self._drop(path)

    def insert_new(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        given, path = self._staged(rows)
        try:
            self._change(given, lambda old, new: merge_ignore(old, new, self.keys).select(*old.columns), batch, adds=True)
            return given.count()
        finally:
            self._drop(path)

    def clean_up(self) -> int:
        """Delete old versions but for ``keep``, and folders that none of the others names; how many folders went.

        Not while a writer is at work: its folders aren't named yet.
        """
        fs, _ = self._fs()
        versions = self._versions()
        for old in versions[: -self.keep]:
            fs.delete(self._hadoop(self._name(old)), False)
        named = {p.split("/")[1] for v in versions[-self.keep :] for folders in self.manifest(v)["parts"].values() for p in folders}
        data = self._hadoop(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in named] if fs.exists(data) else []
        for folder in gone:
            fs.delete(folder, True)
        return len(gone)
