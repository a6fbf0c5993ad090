"""Rank all questions of a snapshot with the active build of a model."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.embed import Model
from ..sources.snapshot import Snapshot
from . import index, search


def rank(snapshot: Snapshot, store: index.IndexStore, profile: Model, *, model_revision: str, embed_queries: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], DataFrame], k: int = 100) -> tuple[DataFrame, dict]:
    """(run, provenance). Everything is checked before a question leaves the engine; ``settle`` writes the embedded questions so that they are sent once."""
    began = time.perf_counter()
    generation = snapshot.manifest["generation_id"]
    build, facts = store.active(generation, profile.model_id)
    chunks = store.rows(build)
    index.check_compatible(
        facts, chunks.count(), generation_id=generation, manifest_sha256=snapshot.manifest_sha256, chunk_count=snapshot.manifest["summary"]["chunks"], model_revision=model_revision, profile=profile
    )
    queries = snapshot.frame("beir/queries").select(F.col("_id").alias("query_id"), "text")
    candidates = snapshot.frame("beir/candidates")
    search.check_inputs(queries, candidates, chunks)
    embedded = settle(embed_queries(queries))
    run = settle(search.scoped_search(embedded, candidates, chunks, k, profile.dimension))
    bad = search.result_problems(run, candidates, k).limit(1).count()
    if bad:
        raise index.IndexBuildError("search gave results outside its contract")
    facts = {
        "generation_id": generation, "generation_manifest_sha256": snapshot.manifest_sha256, "index_build_id": build, "model_id": profile.model_id, "model_revision": model_revision,
        "query_instruction": profile.query_prefix, "chunk_text_profile": profile.passage_profile, "normalization": "l2", "score": "cosine_similarity", "split": "test", "top_k": k,
        "queries": queries.count(), "cost": {"wall_seconds": round(time.perf_counter() - began, 3)},
    }
    return run, facts
