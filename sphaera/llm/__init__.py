"""Operators for training-data work: clusters, top-N, neighbours, token ids, leaks and text quality."""
