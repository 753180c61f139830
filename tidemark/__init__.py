"""tidemark: conversation-archive analytics on Spark DataFrames."""
