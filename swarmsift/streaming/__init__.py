"""Streaming.

The reference is batch-only: every read is a batch parquet/CSV scan and
there is no watermark, window, state or late-data logic to reproduce, so
this package intentionally holds no operators (see README, "Scope").
"""
