"""Evidence adjudication engine on Spark DataFrames."""
