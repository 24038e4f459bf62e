"""A Spark-native home for row-wise Python functions and text analytics."""
