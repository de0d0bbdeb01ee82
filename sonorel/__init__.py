"""sonorel: relational audio fingerprinting and content identification on Spark."""

__version__ = "0.1.0"
