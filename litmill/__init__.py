"""Literature-corpus analytics on PySpark."""
