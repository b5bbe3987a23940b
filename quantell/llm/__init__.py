"""Operators that prepare training data: selection, sampling, ranking, percentiles, clusters, leaks, mixing, splitting."""
