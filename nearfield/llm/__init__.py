"""Training-data operators: cleaning, deduplication, mixing, encoding and archives."""
