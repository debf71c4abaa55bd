"""Spark-native analytics over rotating structures observed on a sphere: observations, tracks, networks, grids and particles."""
