"""Operators for large-scale training-data preparation (sharding, extraction, language ID, deduplication, packing, quality, decontamination, WARC)."""
