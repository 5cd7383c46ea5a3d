"""Readers, writers and parser plug-ins."""
