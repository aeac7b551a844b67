"""Server-log streams and raw samples; the column functions work in batch and streaming."""
