"""operators of the paired-tag engine."""
