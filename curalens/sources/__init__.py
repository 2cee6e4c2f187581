"""sources of curalens."""
