"""locusframe: target-capture phylogenomics on Spark DataFrames."""
