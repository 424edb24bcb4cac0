"""Part of parley, a Spark-native conversation ledger."""
