"""penstock: text analytics over document tables with Spark DataFrames."""
