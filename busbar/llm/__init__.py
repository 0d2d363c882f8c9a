"""Operators for preparing training text at scale, each by one published method."""
