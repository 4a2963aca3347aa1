"""textrill: full-text indexing, access-filtered search and document extraction as Spark plans."""

__version__ = "0.1.0"
