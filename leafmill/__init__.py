"""leafmill: rule-driven extraction and analytics for semi-structured text, expressed as Spark plans."""

__version__ = "0.1.0"
