"""Training-data operators: filtering, deduplication, tokenisation and packing of text corpora."""
