"""Spark-native analytics for property-advert tables."""
