"""Ledger-lineage analytics expressed as Spark DataFrame jobs."""
