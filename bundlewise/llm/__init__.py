"""Training-data operators: deduplication, extraction, scoring, sharding, decontamination, tokenising."""
