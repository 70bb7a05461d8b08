"""Structured Streaming: region counts of a stream of reads."""
