"""Column-level functions: text cleaning, tag lists, scores."""
