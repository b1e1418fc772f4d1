"""tessera: keyed-count, interval, matrix and graph analytics on Spark DataFrames."""
