"""Training-data operators: language ID, dedup, decontamination, tokenisation, sharding, archives."""
