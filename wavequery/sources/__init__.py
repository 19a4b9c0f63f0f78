"""Sources and sinks, and inputs derived from the test tables."""
