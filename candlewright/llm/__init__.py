"""Training-data operators: dedup, quality, scoring, mixing, sharding, chat and tokenisation."""
