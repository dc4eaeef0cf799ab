"""Resumable runs as streams of landing files."""
