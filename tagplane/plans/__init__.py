"""plans of the paired-tag engine."""
