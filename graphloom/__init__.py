"""graphloom: code- and document-graph analytics on Spark DataFrames."""
