"""Data observability on Spark: profiles, metric series, outliers, schema drift,
file feeds and freshness, each as an ordinary DataFrame job."""

__version__ = "0.1.0"
