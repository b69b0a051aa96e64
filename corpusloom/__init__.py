"""Corpusloom: a PySpark-native engine for document corpora.

Every operator is a DataFrame plan; Python runs only where a fold over one
text is inherently sequential, and then on Arrow batches.
"""

__version__ = "0.1.0"
