"""cadenza: ordered, timestamped sequences as Spark DataFrames."""
