"""Relational steps the reports are built from."""
