"""Operators for preparing training data: search, dedup, scans, scoring, mixing, packing and output."""
