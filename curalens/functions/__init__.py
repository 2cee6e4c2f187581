"""functions of curalens."""
