"""Training-data operators: PII, near-duplicates, token files, quality, sharding, packing and more."""
