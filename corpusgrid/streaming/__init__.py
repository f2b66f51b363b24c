"""streaming of corpusgrid."""
