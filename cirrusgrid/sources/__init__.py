"""Reading, writing and validating climate tables."""
