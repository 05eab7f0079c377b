"""Training-data operators: mixing, cleaning, deduplicating, packing, searching."""
