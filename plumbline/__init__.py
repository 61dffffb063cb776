"""plumbline: data-quality metrics, checks and history on PySpark."""
