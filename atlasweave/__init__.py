"""A PySpark engine for multi-source directories of places, and for building text corpora."""
