"""Commerce analytics and corpus processing as Spark DataFrame transformations."""
