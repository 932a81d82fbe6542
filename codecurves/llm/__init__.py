"""Training-data operators: cleaning, deduplication, decontamination, sharding and packing at corpus scale."""
