"""A PySpark-native engine for high-recall document review by continuous active learning."""
