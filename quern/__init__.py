"""quern: retrieval, curation and activity analytics as PySpark DataFrame operators."""
