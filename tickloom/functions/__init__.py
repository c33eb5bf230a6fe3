"""Column functions that Spark has under no name of its own."""
