"""Tessera: ranked retrieval, governed analytics and text safety as Spark jobs."""
