"""Analytics over archives of observed pages and training-data corpora, on Spark DataFrames."""
