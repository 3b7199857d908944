"""Spark-native skill-gap, course-planning and corpus-preparation operators."""
