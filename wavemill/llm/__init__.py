"""Training-data operators: secrets, packing, quality, PII, language, leaks, shards, copies, archives, chat."""
