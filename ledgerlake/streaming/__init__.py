"""Streams: windowed totals with late data, and idempotent uploads."""
