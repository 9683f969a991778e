"""Scalar functions: hashing, statistics, text, diffs and JSON salvage."""
