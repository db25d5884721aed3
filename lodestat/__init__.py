"""lodestat: table and time-series analysis as Spark DataFrame operators."""
