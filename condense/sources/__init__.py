"""Reading listings and registries, writing labels, metrics and day partitions."""
