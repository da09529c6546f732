"""Training-data operators: deduplication, decontamination, filtering, tokenising and sharding of text corpora."""
