"""Source-code, document and web-page mining expressed as Spark DataFrames."""
