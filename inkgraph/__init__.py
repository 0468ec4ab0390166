"""Markdown vault analytics on Spark: parse once into span tables, query with Catalyst."""
