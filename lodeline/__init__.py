"""lodeline: retrieval, conversation memory and text analytics on Spark DataFrames."""
