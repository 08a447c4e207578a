"""Web-page visibility analytics on Spark DataFrames."""
