"""Column -> Column helpers built on pyspark.sql.functions."""
