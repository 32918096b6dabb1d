"""weftline: web extraction and crawl data processing as PySpark DataFrame operators."""

__version__ = "0.1.0"
