"""fitgate: upload-conformance and corpus-preparation operators for PySpark."""

__version__ = "0.1.0"
