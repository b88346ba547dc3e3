"""graphmill: property-graph analytics as lazily planned Spark DataFrames."""
