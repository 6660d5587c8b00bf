"""Readers and writers: Parquet tables, term lines, JSON, XML, CSV, HTML links."""
