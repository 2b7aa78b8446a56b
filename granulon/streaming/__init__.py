"""Incremental ingestion with Structured Streaming: an extension, as the operators' origin has no streams."""
