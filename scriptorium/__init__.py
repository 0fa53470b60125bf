"""A PySpark-native engine for long, noisy transcripts and text collections."""
