"""Lodestone: bibliographic retrieval, record linkage and citation over Spark tables."""

__version__ = "0.1.0"
