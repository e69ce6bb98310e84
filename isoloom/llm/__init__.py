"""Training-data operators: filtering, deduplication, decontamination, tokenisation, sharding."""
