"""Catalog, engine and driver queries."""
