"""pagemill: corpus-scale document processing on PySpark."""
