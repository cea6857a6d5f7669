"""Threats to group candidates: query text, vector, search, roll-up, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulseloom.functions import embedding, texts
from pulseloom.operators import retrieval
from pulseloom.schemas import TOP_K
from pulseloom.session import materialise


def attribute_threats(threats: DataFrame, documents: DataFrame, k: int = TOP_K) -> DataFrame:
    """Detail rows for threats (``query_id`` BIGINT) against evidence documents (``doc_id`` BIGINT,
    ``text`` and metadata)."""
    asked = threats.withColumn("query", texts.query_text(threats))
    queries = embedding.embed_text(asked.select("query_id", "query"), "query", "vector")
    docs = materialise(embedding.embed_text(documents, "text"))  # the index: read several times below
    candidates = retrieval.group_candidates(retrieval.search(queries, docs, k), k)
    return retrieval.attribution_details(asked, retrieval.best_two(candidates))
