"""Before/after analytics on daily series, written on the Spark DataFrame API."""
