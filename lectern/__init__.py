"""Document analytics and assessment-item pipelines as PySpark DataFrame operators."""

__version__ = "0.1.0"
