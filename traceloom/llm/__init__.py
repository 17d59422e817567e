"""Training-data operators: search, quality, packing, sharding, deduplication, encoding and scoring."""
