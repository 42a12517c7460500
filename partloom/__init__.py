"""partloom: dataset-curation analytics for parts, documents and vectors, written as Spark DataFrame jobs."""
