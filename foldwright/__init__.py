"""Feature preparation and classifier selection on Spark DataFrames."""
