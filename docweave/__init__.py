"""PySpark-native preparation of web pages and laid-out documents."""

__version__ = "0.1.0"
