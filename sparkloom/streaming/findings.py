"""The per-file rules over a stream of files: they keep no state, so the batch plan is the stream's plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import catalog
from ..operators import scan
from ..plans import review


def stream_findings(files: DataFrame, rules: list[tuple] = catalog.RULES) -> DataFrame:
    """Findings of the regex rules for a streaming frame (repo, path, text)."""
    return scan.rule_findings(review.scanned(files), rules)


def start(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends findings to a Parquet table for what has arrived, then stops."""
    return stream_findings(files).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
