"""streaming of the paired-tag engine."""
