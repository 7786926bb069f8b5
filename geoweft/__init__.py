"""geoweft: a Spark-native geospatial analytics engine."""
