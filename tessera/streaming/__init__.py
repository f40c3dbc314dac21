"""Structured Streaming entry points.

The reference has no streaming operator (no watermark, window or state); its
only feeds are periodic pulls of a news API.  The Spark form of such a pull is
a file stream over landed responses, processed with the same per-row
operators as the batch path.
"""
