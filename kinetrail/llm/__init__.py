"""Training-data operators: packing, scoring, deduplication, mixing, archives, search."""
