"""changemap: change detection on satellite time series, as Spark DataFrame plans."""

__version__ = "0.1.0"
