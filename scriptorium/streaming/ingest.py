"""Sections of documents that keep arriving: the pipeline looks at one document at a time, so batches are independent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.sections import sections
from scriptorium.plans.rules import RulePack


def section_stream(docs: DataFrame, pack: RulePack) -> DataFrame:
    """The sections of a streaming DataFrame of documents (doc_id, text); stateless, so the append mode works as it is."""
    return sections(docs, pack)


def ingest(docs: DataFrame, pack: RulePack, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the sections of all documents available to Parquet, exactly once; a restart goes on where it stopped."""
    return section_stream(docs, pack).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
