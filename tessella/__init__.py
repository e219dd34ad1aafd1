"""tessella: a PySpark-native analytics engine for governed, source-cited question answering."""
