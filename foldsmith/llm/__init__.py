"""Training-data operators: packing, filters, extraction, near-duplicates, mixing, archives, classifiers."""
