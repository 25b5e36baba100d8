"""siftloom: retrieval and content analytics as Spark DataFrame transformations."""
