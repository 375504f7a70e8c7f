"""Analytics over corpora of hardware assertions, as Spark DataFrames."""
