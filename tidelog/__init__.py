"""A PySpark-native engine over append-only logs of keyed mutations."""
