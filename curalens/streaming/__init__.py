"""streaming of curalens."""
