"""Perigon: Spark-native analytics over geo-tagged observation records."""
