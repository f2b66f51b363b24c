"""sources of corpusgrid."""
