"""Operators for preparing training corpora: language, duplicates, toxicity, licences, mixing and token files."""
