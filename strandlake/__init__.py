"""strandlake: sequence-classification and corpus analytics expressed on Spark DataFrames."""
