"""progscan: schema-driven decoding, storage and queries over program activity, on Spark."""

__version__ = "0.1.0"
