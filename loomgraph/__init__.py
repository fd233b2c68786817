"""Code-lineage and impact analytics on PySpark."""
