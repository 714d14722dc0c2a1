"""setwise: a set-oriented analytics engine that lowers every query to Spark DataFrames."""
