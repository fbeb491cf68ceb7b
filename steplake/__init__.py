"""Analysis of documents and step-by-step task trajectories on Spark DataFrames."""
