"""siltstone: storage and file-inventory analytics on Spark DataFrames."""
