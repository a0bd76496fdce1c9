"""Assurance analytics on PySpark: data-quality, drift, chain, lineage and risk operators."""
