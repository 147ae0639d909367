"""quiverlake: vector search, hybrid ranking and data preparation as PySpark plans."""
