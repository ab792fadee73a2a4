"""strandloom: mosaic tandem-repeat analytics on Spark DataFrames."""
