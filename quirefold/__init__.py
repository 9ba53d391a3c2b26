"""quirefold: page-layout analytics on Spark DataFrames."""
