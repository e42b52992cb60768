"""Readers and sinks."""

from ..operators.ingest import read_declared_csv, write_partitioned

__all__ = ["read_declared_csv", "write_partitioned"]
