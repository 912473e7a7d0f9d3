"""docloom: document retrieval and evaluation over Spark DataFrames."""
