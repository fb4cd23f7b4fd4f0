"""Structured Streaming into and out of the store."""
