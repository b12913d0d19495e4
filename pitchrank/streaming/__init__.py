"""The incremental form of the ingest."""
