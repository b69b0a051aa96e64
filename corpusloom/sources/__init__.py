"""Readers of tables and documents, corpus catalog, sinks."""
