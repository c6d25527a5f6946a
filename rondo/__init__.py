"""rondo: a PySpark-native engine for ordered event sequences, vectors and text corpora."""
