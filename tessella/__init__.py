"""Spark-native sparse reconstruction analytics: images, keypoints, matches, poses and points as DataFrames."""
