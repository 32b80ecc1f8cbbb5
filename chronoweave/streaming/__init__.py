"""Streams of samples: ingest into a store, windowed aggregates, duplicates and dedupe intervals with bounded state."""

from .ingest import accepted_stream, sink, without_duplicates
from .windows import sessions, sliding, tumbling

__all__ = ["accepted_stream", "sessions", "sink", "sliding", "tumbling", "without_duplicates"]
