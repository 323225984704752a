"""litloom: a PySpark-native engine for literature and evidence tables."""
