"""Structured Streaming jobs over crawl events."""
