"""Dataset directory readers and run-log files."""
