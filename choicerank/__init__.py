"""Choice-ranking features, rerankers and metrics as Spark DataFrame operators."""
