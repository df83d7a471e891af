"""tidemark: snapshot diffs, change logs and digests as Spark DataFrames, and operators for training data."""
