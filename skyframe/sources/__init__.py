"""Readers for the raw feeds and writers for the lake and the serving store."""
