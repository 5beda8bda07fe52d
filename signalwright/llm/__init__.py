"""Training-data operators: packing, mixing, scoring, language, shards, token files, dedup, quality, media."""
