"""Operators that Spark has no single call for."""

from sparkloom.operators.hotkeys import hot_keys, salted_join
from sparkloom.operators.joins import asof_join, overlap_join, range_join
from sparkloom.operators.negation import not_in
from sparkloom.operators.ranking import top_k_per_group
from sparkloom.operators.sessions import sessions
from sparkloom.operators.sketches import merge_sketches, read_sketches, slice_sketches

__all__ = ["asof_join", "hot_keys", "merge_sketches", "not_in", "overlap_join", "range_join", "read_sketches", "salted_join", "sessions", "slice_sketches", "top_k_per_group"]
