"""sessionloom: a PySpark-native analytics engine for search logs."""
