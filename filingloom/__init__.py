"""Filing analytics on Spark: declarative DataFrame operators over filing tables."""

__all__ = ["__version__"]
__version__ = "0.1.0"
