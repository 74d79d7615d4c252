"""attestry: verifiable-knowledge analytics as ordinary Spark DataFrame plans."""

__version__ = "0.1.0"
