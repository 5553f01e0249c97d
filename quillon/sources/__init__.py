"""Adapters from tables and files to the element schema."""
