"""Point clouds, neighbourhood graphs and lifted geometry as Spark DataFrames."""
