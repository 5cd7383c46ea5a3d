"""Document retrieval and question answering, and corpus preparation, on Spark."""
