"""Operators for preparing training corpora: scanning, packing, filtering, deduplicating, mixing, scoring."""
