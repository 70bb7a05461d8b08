"""Operators: intervals, paths, mapping, read lengths, short reads, communities, EM, condition numbers, features."""
