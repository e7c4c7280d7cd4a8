"""sources of the paired-tag engine."""
