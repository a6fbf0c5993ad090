"""Immutable snapshots of a dataset and the pointer to the current one.

A snapshot is a folder of Parquet artifacts and a manifest. It is written to a staging folder, checked, renamed to its id and only then pointed to; any
failure leaves the pointer where it was. Readers resolve the pointer once.
"""

from __future__ import annotations

import hashlib
import json
import os
import secrets
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..errors import GenerationError, PublicationError
from ..operators import validate
from .sinks import whole_file

PIPELINE = "passagemill"
MANIFEST = "meta/manifest.json"
REQUIRED = ("pipeline", "split", "generation_id", "generated_at", "source_sha256", "source_row_count", "chunking", "summary")
COUNTERS = ("source_rows", "rejected_sources", "documents", "chunks", "queries", "queries_retained", "dropped_queries", "qrels", "unmapped_citations", "plain_text_violations")


def new_generation_id() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%d-%H%M%S}-{secrets.token_hex(3)}"


@dataclass(frozen=True)
class Snapshot:
    """One snapshot, pinned: later publications don't change what it reads."""

    spark: SparkSession
    root: Path
    manifest: dict

    def frame(self, artifact: str) -> DataFrame:
        return self.spark.read.schema(schemas.SNAPSHOT[artifact]).parquet(str(self.root / artifact))

    @property
    def frames(self) -> dict[str, DataFrame]:
        return {name: self.frame(name) for name in schemas.SNAPSHOT}

    @property
    def manifest_sha256(self) -> str:
        return hashlib.sha256((self.root / MANIFEST).read_bytes()).hexdigest()


def read_manifest(root: Path) -> dict:
    try:
        found = json.loads((root / MANIFEST).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise GenerationError(f"{root} has no {MANIFEST}") from None
    except ValueError as error:
        raise GenerationError(f"{MANIFEST} is no JSON: {error}") from None
    if not isinstance(found, dict) or (missing := [k for k in REQUIRED if k not in found]):
        raise GenerationError(f"{MANIFEST} lacks {', '.join(missing) if isinstance(found, dict) else 'an object'}")
    if found["pipeline"] != PIPELINE:
        raise GenerationError(f"{MANIFEST} is of pipeline {found['pipeline']!r}")
    summary = found["summary"]
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not isinstance(summary, dict) or not whole(found["source_row_count"]) or (bad := [c for c in COUNTERS if not whole(summary.get(c))]):
        raise GenerationError(f"{MANIFEST} has counters that are no integers: {', '.join(bad) if isinstance(summary, dict) else 'summary'}")
    return found


def validate_snapshot(spark: SparkSession, root: Path, *, staged: bool = False) -> Snapshot:
    """Identity, artifacts and the dataset's contract; raises GenerationError."""
    manifest = read_manifest(root)
    if manifest["split"] != "test":
        raise GenerationError(f"only the test split is published, not {manifest['split']!r}")
    if not staged and manifest["generation_id"] != root.name:
        raise GenerationError(f"{root.name} holds the manifest of {manifest['generation_id']}")
    for artifact in schemas.SNAPSHOT:
        if not (root / artifact / "_SUCCESS").exists():
            raise GenerationError(f"{root.name} lacks {artifact}")
    snapshot = Snapshot(spark, root, manifest)
    validate.check(snapshot.frames, manifest["summary"])
    return snapshot


class Publisher:
    """The folder that holds all snapshots and the ``current`` pointer."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)

    @property
    def _generations(self) -> Path:
        return self.root / "generations"

    def current_id(self) -> str | None:
        pointer = self.root / "current"
        if pointer.is_symlink():
            return Path(os.readlink(pointer)).name
        if pointer.exists():
            raise PublicationError(f"{pointer} is no symbolic link; refusing to replace it")
        return None

    def publish(self, artifacts: dict[str, DataFrame], summary: dict[str, int], *, generation_id: str | None = None, facts: dict | None = None, before_switch: Callable[[Path], None] | None = None) -> Snapshot:
        """Stage, check, rename, check the identity, and point to it."""
        self.current_id()
        name = generation_id or new_generation_id()
        staging, final = self._generations / f".building-{name}", self._generations / name
        if final.exists():
            raise PublicationError(f"{name} exists")
        try:
            for artifact, df in artifacts.items():
                df.write.parquet(str(staging / artifact))
            manifest = {
                "pipeline": PIPELINE, "split": "test", "generation_id": name, "generated_at": datetime.now(timezone.utc).isoformat(), "source_sha256": "",
                "source_row_count": summary["source_rows"], "chunking": {}, **(facts or {}), "summary": summary,
            }
            with whole_file(staging / MANIFEST) as file:
                json.dump(manifest, file, ensure_ascii=False, indent=2)
            validate_snapshot(self.spark, staging, staged=True)
            staging.rename(final)
            if before_switch:
                before_switch(final)
            if read_manifest(final)["generation_id"] != name:
                raise GenerationError(f"{name} holds another manifest")
            self._switch(name)
        except BaseException:
            shutil.rmtree(staging, ignore_errors=True)
            if final.exists() and self.current_id() != name:
                shutil.rmtree(final, ignore_errors=True)
            raise
        return Snapshot(self.spark, final, read_manifest(final))

    def activate(self, generation_id: str) -> Snapshot:
        """Point to an older snapshot after checking it again."""
        self.current_id()
        snapshot = validate_snapshot(self.spark, self._generations / generation_id)
        self._switch(generation_id)
        return snapshot

    def _switch(self, name: str) -> None:
        draft = self.root / f".current-{secrets.token_hex(4)}"
        draft.symlink_to(Path("generations") / name)
        try:
            os.replace(draft, self.root / "current")
        except OSError as error:
            draft.unlink(missing_ok=True)
            raise PublicationError(f"the pointer can't be switched: {error}") from error

    def load(self, generation_id: str | None = None) -> Snapshot:
        """The named snapshot, or the current one, resolved now."""
        name = generation_id or self.current_id()
        if not name:
            raise GenerationError("nothing is published")
        return Snapshot(self.spark, self._generations / name, read_manifest(self._generations / name))
