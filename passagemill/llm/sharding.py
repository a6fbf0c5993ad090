"""A document store of immutable shards with size-tiered compaction.

Method. Each arrival is appended as small immutable shards. A version of the store is a manifest that lists its shards; it is
committed by one atomic step that gives the written manifest the next version's name and fails if another writer took it, so readers see one
version or the next and never a mixture. Compaction looks at the shards by size tier (powers of ``growth`` below the
target size), takes runs of ``fan_in`` or more of one tier, rewrites each run as shards of about the target size,
and commits a version that lists the new shards instead of the old ones. Tiers make every byte be
rewritten at most once per tier.

Writers that lose a race try again on the version that won. An append's shards go with any version. A merge stands as long as all shards that it
replaces are still listed; else its result is dropped and compaction plans anew. Old versions stay readable: only :meth:`ShardStore.vacuum`, a call
of its own, deletes manifests but the last ``keep`` and files that no manifest left lists, and both only once they are older than ``age``, so that what a writer
hasn't committed yet stays.

A merge is one Spark job without a shuffle: a task writes one shard and reads old shards' splits for it, about the target size in all.
Lost executors only repeat tasks: shards of an attempt that wasn't committed are in no manifest.

Defined results. Nulls, repeated rows and very long texts are stored as they are; extra columns too. An empty arrival
adds no shard. An empty store reads as no rows if it has a schema, else it is an error.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
#: Times that a writer tries to commit before it gives up.
ATTEMPTS = 20
#: Seconds that files which no version lists are left alone: longer than any write takes.
AGE = 7 * 86_400.0


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # -- manifests ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """Make ``shards`` the version after ``base``; raises CommitConflict if it exists."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": shards}
        target = self._path(f"{self.root}/manifests/v{new['version']:08d}.json")
        draft = self._path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        try:
            if not self._take_name(draft, target):
                raise CommitConflict(f"version {new['version']} exists")
        finally:
            self._fs.delete(draft, False)
        return new

    def _take_name(self, draft, target) -> bool:
        """Give a written file its name, if no file has it: one atomic step."""
        jvm = self.spark.sparkContext._jvm
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename would replace the target; a link to the file fails
                jvm.java.nio.file.Files.createLink(jvm.java.nio.file.Paths.get(target.toUri().getPath(), self._strings()), jvm.java.nio.file.Paths.get(draft.toUri().getPath(), self._strings()))
            else:
                files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                files.rename(draft, target, options)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _strings(self):
        return self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 0)

    def _commit_on_latest(self, change, schema: str) -> dict | None:
        """Commit ``change(shards)`` of the latest version, again if another writer was first; None if the change no longer applies."""
        for attempt in range(ATTEMPTS):
            base = self.manifest()
            shards = change(base["shards"])
            if shards is None:
                return None
            try:
                return self.commit(base, shards, schema)
            except CommitConflict:
                time.sleep(min(1.0, 0.01 * 2**attempt) * random.random())
        raise CommitConflict(f"other writers were first {ATTEMPTS} times")

    # -- shards ---------------------------------------------------------------------------------

    def _shards_in(self, folder: str, tier: int) -> list[dict]:
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        return [{"path": f"{folder}/{n}", "bytes": size, "merges": tier} for n, size in sorted(found) if n.endswith(".parquet")]

    def append(self, rows: DataFrame) -> dict:
        """Write an arrival as shards of its own and commit a version with them."""
        folder = f"shards/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        new = self._shards_in(folder, 0)
        return self._commit_on_latest(lambda shards: shards + new, rows.schema.json())

    def plan(self, shards: list[dict], target: int = TARGET_BYTES, growth: int = 4, fan_in: int = 4) -> list[list[dict]]:
        """Runs of shards to merge, each of one size tier: ``fan_in`` shards or more, or fewer that fill half a target."""
        tiers: dict[int, list[dict]] = {}
        for shard in shards:
            if 2 * shard["bytes"] < target:
                tiers.setdefault(int(math.log(target / max(1, shard["bytes"]), growth)), []).append(shard)
        return [sorted(run, key=lambda s: s["path"]) for run in tiers.values() if len(run) >= fan_in or len(run) > 1 and 2 * sum(s["bytes"] for s in run) >= target]

    def compact(self, target: int = TARGET_BYTES, growth: int = 4, fan_in: int = 4) -> dict:
        """Merge run after run until no tier has one; each merge commits a version."""
        while True:
            base = self.manifest()
            for run in self.plan(base["shards"], target, growth, fan_in):
                files = max(1, round(sum(s["bytes"] for s in run) / target))
                if files < len(run):
                    break
            else:
                return base
            schema = T.StructType.fromJson(json.loads(base["schema"]))
            folder = f"shards/{uuid.uuid4().hex}"
            # merging shards needs no shuffle: a writer reads some shards' splits one after the other
            self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in run)).coalesce(files).write.parquet(f"{self.root}/{folder}")
            gone, merged = {s["path"] for s in run}, self._shards_in(folder, 1 + max(s["merges"] for s in run))

            def change(shards: list[dict], gone=gone, merged=merged) -> list[dict] | None:
                kept = [s for s in shards if s["path"] not in gone]
                return kept + merged if len(shards) - len(kept) == len(gone) else None

            if self._commit_on_latest(change, base["schema"]) is None:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def vacuum(self, age: float = AGE, keep: int = 1) -> None:
        """Delete manifests but the last ``keep``, and files that no manifest lists, where they are older than ``age`` seconds."""
        limit = (time.time() - age) * 1000
        old = lambda status: status.getModificationTime() <= limit
        versions = self.versions()
        for version in versions[: max(0, len(versions) - max(1, keep))]:
            path = self._path(f"{self.root}/manifests/v{version:08d}.json")
            if old(self._fs.getFileStatus(path)):
                self._fs.delete(path, False)
        if not self._fs.exists(self._path(f"{self.root}/shards")):
            return
        listed = {s["path"] for v in self.versions() for s in self.manifest(v)["shards"]}
        folders = {p.rsplit("/", 1)[0] for p in listed}
        for folder in self._fs.listStatus(self._path(f"{self.root}/shards")):
            name = f"shards/{folder.getPath().getName()}"
            files = self._fs.listStatus(folder.getPath())
            if name not in folders and old(folder) and all(map(old, files)):
                self._fs.delete(folder.getPath(), True)
            elif name in folders:
                for file in files:
                    if (path := f"{name}/{file.getPath().getName()}").endswith(".parquet") and path not in listed and old(file):
                        self._fs.delete(file.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError("nothing was ever appended")
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.root}/{s['path']}" for s in manifest["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
