"""brindle: a Spark-native analytics engine with a small-database SQL dialect on top of Catalyst."""

__version__ = "0.1.0"
