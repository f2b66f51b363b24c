"""functions of corpusgrid."""
