"""Statistics: pairs and ranks in Spark, exact p-values on the driver."""
