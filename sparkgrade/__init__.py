"""A PySpark-native engine for graded model output, rollout data and corpus preparation."""
