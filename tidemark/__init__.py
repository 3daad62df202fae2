"""Tidemark: customer-retention analytics as PySpark DataFrame transforms."""
