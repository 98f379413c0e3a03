"""Training-data operators: deduplication, tokenising, scoring, filtering, search, archives and packing."""
