"""Candidate tables, prefix sharing, evaluation jobs and run-log analysis."""
