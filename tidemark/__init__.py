"""Delta analytics over collections of public queue documents, on Spark."""
