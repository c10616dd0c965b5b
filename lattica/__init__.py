"""lattica: a PySpark-native analytics engine for spatial tile, image and point data."""
