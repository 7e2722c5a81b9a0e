"""Statistics, transformers, classifiers and metrics over labelled tables."""
