"""Training-data operators: dedup, scoring, mixing, packing, search and redaction."""
