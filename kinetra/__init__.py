"""kinetra: reaction-evidence analytics on PySpark."""
