"""Operators for large text corpora: scans, formatting, extraction, dedup, filters, sampling."""
