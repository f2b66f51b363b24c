"""operators of corpusgrid."""
