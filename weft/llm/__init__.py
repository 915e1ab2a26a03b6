"""Training-data operators: mixing, quality, dedup, language id, packing, secrets, token files."""
