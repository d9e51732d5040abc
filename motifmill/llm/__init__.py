"""Training-data operators: deduplication, quality, packing, tokenising, archives, chat and LM scoring."""
