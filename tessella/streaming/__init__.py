"""Batches of record streams, stateful framing, and event-time windows."""
