"""Column functions."""

from sparkloom.functions.vectors import cosine, dot, norm

__all__ = ["cosine", "dot", "norm"]
