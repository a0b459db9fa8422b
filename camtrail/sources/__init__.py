"""Reading, writing and maintaining the index tables."""
