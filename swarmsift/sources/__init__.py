"""Sources, sinks and test fixtures derived from the given tables."""
