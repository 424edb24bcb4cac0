"""parley: a Spark-native conversation ledger and analytics engine."""
