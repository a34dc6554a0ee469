"""gristmill: a PySpark-native analytics engine for large corpora of public comments."""
