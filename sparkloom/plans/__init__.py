"""Queries over the tables. Importing the package registers all of them."""

from sparkloom.plans import catalog, keyed, streams

__all__ = ["catalog", "keyed", "streams"]
