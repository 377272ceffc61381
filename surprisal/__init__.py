"""Text-entropy analytics on Spark: how predictable are texts, measured with DataFrame plans."""

__version__ = "0.1.0"
