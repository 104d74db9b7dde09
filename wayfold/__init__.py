"""Spark-native operators for visit trajectories, catalogs, ranking evaluation and city statistics."""
