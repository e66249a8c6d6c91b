"""Structured Streaming jobs."""

from sparkloom.streaming.events import distinct_events, running_totals, windowed_counts
from sparkloom.streaming.run import drain, state_store
from sparkloom.streaming.stateful import expiring_totals, matched_within, session_totals

__all__ = ["distinct_events", "drain", "expiring_totals", "matched_within", "running_totals", "session_totals", "state_store", "windowed_counts"]
