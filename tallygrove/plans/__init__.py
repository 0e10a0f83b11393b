"""The named reports."""
