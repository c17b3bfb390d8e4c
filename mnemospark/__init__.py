"""mnemospark: memory analytics on PySpark (retrieval, belief dynamics, mining, experience lifecycle, data checks)."""

__version__ = "0.1.0"
