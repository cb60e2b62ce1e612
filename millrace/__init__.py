"""millrace: a Spark-native analytics engine for market time series and option overlays."""
