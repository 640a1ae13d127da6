"""Security analytics over source code and dependency lists, on Spark."""
