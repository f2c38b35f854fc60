"""API-observability analytics expressed as PySpark DataFrame operators."""
