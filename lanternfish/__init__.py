"""Spark-native analytics for text artifacts: detection, identity, lineage of captures and event logs."""
