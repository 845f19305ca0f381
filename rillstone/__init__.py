"""rillstone: versioned records, change streams and vectors on Spark."""
