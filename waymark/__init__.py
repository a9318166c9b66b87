"""waymark: demand-aware vector search and retrieval analytics on PySpark."""
