"""PySpark package; see README.md for what is and is not in it."""
