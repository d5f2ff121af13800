"""Training-data operators: media, token files, deduplication, packing, scoring."""
