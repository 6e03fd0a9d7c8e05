"""PySpark library for sky-survey tables."""
