"""strandline: metadata tables of content-addressed distribution systems as Spark DataFrames."""
