"""Intentionally empty.

The analyses read closed extracts only; there is no stream, watermark, late
data or custom state to reproduce, so no Structured Streaming operator is
provided (see README, "Not built / re-aimed").
"""
