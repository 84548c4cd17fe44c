"""Readers: files of many formats as documents with blocks."""

from .files import documents, extensions, parsed, register

__all__ = ["documents", "extensions", "parsed", "register"]
