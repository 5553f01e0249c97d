"""Relational operators over elements, chunks and index tables."""
