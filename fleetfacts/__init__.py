"""Code-intelligence facts for a fleet of repositories, as Spark DataFrames."""
