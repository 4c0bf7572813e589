"""Set-oriented text, JSON, tabular and document operators for PySpark."""
