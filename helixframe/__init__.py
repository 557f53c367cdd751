"""A PySpark-native engine for biological sequences and genomic intervals."""
