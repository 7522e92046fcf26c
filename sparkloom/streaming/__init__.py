"""Structured Streaming over events and the lake."""
