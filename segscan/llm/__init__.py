"""Operators for training data: event runs, container packing, evaluation leaks, reading level."""
