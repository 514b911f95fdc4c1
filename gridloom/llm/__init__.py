"""Training-data operators: packing, tokenising, classifiers, deduplication, search and privacy."""
