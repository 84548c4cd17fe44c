"""Operators over documents, blocks, tables and corpora."""
