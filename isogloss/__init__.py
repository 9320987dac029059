"""isogloss: distances between groups of sequences, clusterings of them, and their evaluation, on Spark."""
