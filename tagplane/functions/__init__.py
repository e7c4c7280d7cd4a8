"""functions of the paired-tag engine."""
