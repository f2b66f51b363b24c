"""plans of corpusgrid."""
