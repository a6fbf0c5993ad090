"""Index builds: their states, rows, checks and the active one of each snapshot and model.

The store is a folder: ``builds.json`` (states and the active pointers, replaced whole under a lock) and one immutable Parquet partition of vectors for each build.
"""

from __future__ import annotations

import fcntl
import json
import secrets
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import IndexBuildError, IndexCompatibilityError, IndexNotReadyError, raise_if_any
from ..functions.vectors import is_unit
from ..sources.embed import Model
from ..sources.sinks import whole_file
from .validate import bijection

#: The states that a build goes through.
BUILDING, VALIDATED, ACTIVE, SUPERSEDED, FAILED = "building", "validated", "active", "superseded", "failed"


@dataclass(frozen=True)
class Provenance:
    model_id: str
    model_revision: str
    dimension: int
    generation_id: str
    generation_manifest_sha256: str
    source_sha256: str
    query_instruction: str
    chunk_text_profile: str
    chunk_count: int
    split: str = "test"
    metric: str = "cosine"
    normalized: bool = True


class IndexStore:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)  # safe to repeat

    @contextmanager
    def _state(self, write: bool = True) -> Iterator[dict]:
        """Builds and active pointers; changes are written whole, under a lock, if the block ends well."""
        path = self.root / "builds.json"
        with (self.root / ".lock").open("w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            state = json.loads(path.read_text()) if path.exists() else {"builds": {}, "active": {}}
            yield state
            if write:
                with whole_file(path) as file:
                    json.dump(state, file)

    def _vectors(self, build: str) -> str:
        return str(self.root / "indexed_chunks" / f"index_build_id={build}")

    def _move(self, state: dict, build: str, allowed: tuple[str, ...], to: str) -> None:
        found = state["builds"].get(build)
        if not found:
            raise IndexBuildError(f"no build {build}")
        if found["status"] not in allowed:
            raise IndexBuildError(f"build {build} is {found['status']}, not {' or '.join(allowed)}")
        found |= {"status": to, "updated_at": datetime.now(timezone.utc).isoformat()}

    def create(self, provenance: Provenance, profile: Model) -> str:
        """Register a build; its model, dimension and split must be what the store takes."""
        if provenance.model_id != profile.model_id or provenance.dimension != profile.dimension:
            raise IndexBuildError(f"{provenance.model_id} has {profile.dimension} dimensions, not {provenance.dimension}")
        if provenance.split != "test" or provenance.metric != "cosine" or not provenance.normalized:
            raise IndexBuildError("only normalized cosine builds of the test split are stored")
        now = datetime.now(timezone.utc)
        build = f"ib-{now:%Y%m%d-%H%M%S}-{secrets.token_hex(4)}"
        with self._state() as state:
            state["builds"][build] = asdict(provenance) | {"status": BUILDING, "created_at": now.isoformat(), "updated_at": now.isoformat()}
        return build

    def insert(self, build: str, chunks: DataFrame) -> None:
        """Append rows (chunk_id, document_id, chunk_index, embedding); only while the build is being built."""
        with self._state(write=False) as state:
            self._move(state, build, (BUILDING,), BUILDING)
        chunks.select("chunk_id", "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(self._vectors(build))

    def rows(self, build: str) -> DataFrame:
        schema = schemas.INDEXED_CHUNKS
        return self.spark.read.schema(type(schema)(schema.fields[1:])).parquet(self._vectors(build)).select(F.lit(build).alias("index_build_id"), "*")

    def validate(self, build: str, corpus: DataFrame) -> None:
        """Rows must be exactly the corpus (chunk_id, document_id, chunk_index), vectors of the build's dimension and unit length."""
        with self._state(write=False) as state:
            self._move(state, build, (BUILDING,), BUILDING)
            facts = state["builds"][build]
        rows = self.rows(build)
        repeated = rows.groupBy("chunk_id").count().filter("count > 1").orderBy("chunk_id").limit(6).collect()
        raise_if_any([r["chunk_id"] for r in repeated], IndexBuildError, "passages stored more than once")
        wrong = bijection(corpus, rows, "chunk_id", ("document_id", "chunk_index")).orderBy("chunk_id").limit(6).collect()
        raise_if_any([f"{r['chunk_id']} ({r['problem']})" for r in wrong], IndexBuildError, "rows aren't the corpus")
        bad = rows.filter(~is_unit(F.col("embedding"), facts["dimension"])).orderBy("chunk_id").select("chunk_id").limit(6).collect()
        raise_if_any([r["chunk_id"] for r in bad], IndexBuildError, "vectors of a wrong size or length")
        if (n := rows.count()) != facts["chunk_count"]:
            raise IndexBuildError(f"{n} rows instead of {facts['chunk_count']}")
        with self._state() as state:
            self._move(state, build, (BUILDING,), VALIDATED)

    def activate(self, build: str) -> None:
        """Make a validated build the active one of its snapshot and model; the one before is superseded in the same step."""
        with self._state() as state:
            self._move(state, build, (VALIDATED,), ACTIVE)
            facts = state["builds"][build]
            key = f"{facts['generation_id']}\t{facts['model_id']}"
            if before := state["active"].get(key):
                self._move(state, before["index_build_id"], (ACTIVE,), SUPERSEDED)
            state["active"][key] = {"index_build_id": build, "activated_at": datetime.now(timezone.utc).isoformat()}

    def fail(self, build: str) -> None:
        """Give a build up; its rows stay and are never chosen."""
        with self._state() as state:
            self._move(state, build, (BUILDING, VALIDATED), FAILED)

    def active(self, generation_id: str, model_id: str) -> tuple[str, dict]:
        with self._state(write=False) as state:
            found = state["active"].get(f"{generation_id}\t{model_id}")
            if not found:
                raise IndexNotReadyError(f"no active build for {model_id} on {generation_id}")
            return found["index_build_id"], state["builds"][found["index_build_id"]]

    def builds(self) -> DataFrame:
        with self._state(write=False) as state:
            rows = [{"index_build_id": k, **v} for k, v in state["builds"].items()]
        return self.spark.createDataFrame(rows, schemas.INDEX_BUILDS)

    def build(self, corpus: DataFrame, provenance: Provenance, profile: Model, embed: Callable[[DataFrame], DataFrame]) -> str:
        """Create, embed, insert, validate and activate; any failure marks the build failed."""
        build = self.create(provenance, profile)
        try:
            self.insert(build, embed(corpus.orderBy("document_id", "chunk_index", "chunk_id")))
            self.validate(build, corpus.select("chunk_id", "document_id", F.col("chunk_index").cast("int").alias("chunk_index")))
            self.activate(build)
        except BaseException:
            self.fail(build)
            raise
        return build


def check_compatible(facts: dict, rows: int, *, generation_id: str, manifest_sha256: str, chunk_count: int, model_revision: str, profile: Model) -> None:
    """Refuse a build made for other data, another model, or other texts."""
    wanted = {
        "generation_id": generation_id, "generation_manifest_sha256": manifest_sha256, "model_id": profile.model_id, "model_revision": model_revision,
        "query_instruction": profile.query_prefix, "chunk_text_profile": profile.passage_profile, "dimension": profile.dimension, "metric": "cosine", "normalized": True,
    }
    differ = [f"{k} is {facts.get(k)!r}, not {v!r}" for k, v in wanted.items() if facts.get(k) != v]
    if not rows == facts["chunk_count"] == chunk_count:
        differ.append(f"{rows} rows, {facts['chunk_count']} declared, {chunk_count} published")
    raise_if_any(differ, IndexCompatibilityError, "the active build doesn't fit")


def active_builds(log: DataFrame) -> DataFrame:
    """The latest activation of each key in an activation log (key, at, build): what an upsert would leave."""
    return log.groupBy("key").agg(F.max_by("build", F.struct("at", "build")).alias("build"), F.max("at").alias("at"))
