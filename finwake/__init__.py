"""finwake: point-in-time transfer-risk features and alert budgets on PySpark."""

__version__ = "0.1.0"
