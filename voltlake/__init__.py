"""A PySpark-native analytics engine for neurophysiology datasets and training corpora."""
