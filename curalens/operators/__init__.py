"""operators of curalens."""
