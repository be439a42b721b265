"""A PySpark-native engine for crawl analytics and versioned document search."""
