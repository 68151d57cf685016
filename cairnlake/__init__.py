"""cairnlake: a PySpark-native analytics engine for corpora of linked documents."""
