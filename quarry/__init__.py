"""Catalog-replication and content-dedup analytics as Spark DataFrame operators."""
