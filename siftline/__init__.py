"""siftline: log sifting, anomaly scoring and findings history as Spark DataFrames."""
