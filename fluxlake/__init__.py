"""A Spark-native analytics engine for ensembles of simulated fields and the tables around them."""
