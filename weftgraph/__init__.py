"""Spark-first analytics over source-code graphs: parsing, linking, history and export."""
