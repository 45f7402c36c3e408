"""Tabulon: declarative document-to-table mapping, loading and corpus preparation on Spark."""
