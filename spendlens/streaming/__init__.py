"""Structured Streaming jobs: incremental ingest of extraction documents."""

from spendlens.streaming.ingest import ingest_batch, run_ingest_stream

__all__ = ["ingest_batch", "run_ingest_stream"]
