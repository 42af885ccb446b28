"""Training-data operators: privacy, decontamination, dedup, mixing and measurement over document tables."""
