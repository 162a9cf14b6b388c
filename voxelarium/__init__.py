"""Spark-native analytics over multi-resolution voxel volumes and the surfaces embedded in them."""
