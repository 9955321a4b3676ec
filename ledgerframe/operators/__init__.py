"""State, history, scans, indexes and lookups as DataFrame plans."""
