"""Column functions."""

from . import ids, kv, text

__all__ = ["ids", "kv", "text"]
