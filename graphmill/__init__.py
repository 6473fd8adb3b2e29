"""graphmill: developer-intelligence and corpus analytics on Spark DataFrames."""
