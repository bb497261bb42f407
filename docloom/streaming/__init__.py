"""Statements over streams: filters and projections of one table run on a readStream as they do on a table."""

from docloom.streaming.run import stream_table, windowed_counts, write_table

__all__ = ["stream_table", "windowed_counts", "write_table"]
