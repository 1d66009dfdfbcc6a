"""Training-data operators: deduplication, scans, mixing, sharding, quality and decontamination."""
