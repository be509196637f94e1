"""lorefold: a Spark-native engine for document knowledge bases and the data processing around them."""
