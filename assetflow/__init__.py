"""assetflow: a PySpark-native analytics engine for media-asset corpora."""

__version__ = "0.1.0"
