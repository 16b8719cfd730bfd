"""PySpark-native analytics for construction price schedules."""
