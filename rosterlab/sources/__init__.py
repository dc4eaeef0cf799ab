"""Readers, text parsers, writers, and adapters from star-schema tables."""
