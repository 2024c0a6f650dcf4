"""quire: a Spark-native engine for document analytics and training-data preparation."""
