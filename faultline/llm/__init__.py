"""Training-data operators: near-duplicate search, filtering, scoring, tokenising, extraction, mixing, privacy."""
