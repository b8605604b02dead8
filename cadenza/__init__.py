"""Cadenza: a Spark-native analytics engine for track libraries used in continuous-mix programming."""
