"""PySpark-native URL-risk analytics: features, training, scoring and feedback as DataFrame plans."""
