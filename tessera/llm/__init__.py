"""Operators that prepare training data: duplicates, groups, clusters, neighbours, packing, mixing and splitting."""
