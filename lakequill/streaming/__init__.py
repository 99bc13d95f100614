"""Log ingest as a stream."""
