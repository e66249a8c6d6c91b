"""Reading and writing of tables."""

from sparkloom.sources.arrow_shards import read_shards, write_shards
from sparkloom.sources.shared import shared_path
from sparkloom.sources.tables import load, read_any, write_any

__all__ = ["load", "read_any", "read_shards", "shared_path", "write_any", "write_shards"]
