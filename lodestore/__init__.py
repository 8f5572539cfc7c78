"""lodestore: memory and corpus analytics as Spark DataFrame, SQL and streaming operators."""
