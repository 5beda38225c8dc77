"""Evidence retrieval and document analytics over Spark DataFrames."""
