"""PySpark-native analytics over bank-statement evidence ledgers."""
