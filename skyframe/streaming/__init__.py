"""Structured Streaming path: dedupe, pivot, detect, alert."""
