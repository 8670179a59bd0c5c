"""Training-data operators: deduplication, tokens, packing, quality, extraction, search, scoring."""
