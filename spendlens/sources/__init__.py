"""Sources and sinks: driver tables, statement documents, JSON extractions, Parquet store."""
