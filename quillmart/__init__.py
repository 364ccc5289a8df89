"""A PySpark analytics library for merchant, district and point-of-sale data."""
