"""Training-data operators: deduplication, filtering, labelling and packing of text corpora."""
