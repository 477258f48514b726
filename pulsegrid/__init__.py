"""Quality-indicator analytics for emergency medical services on Spark DataFrames."""
