"""Recommendation analytics over click-stream tables, expressed as Spark DataFrame operators."""
