"""Permission-risk analytics as Spark DataFrame and SQL operators."""
