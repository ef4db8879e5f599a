"""Alert-telemetry analytics on Spark: every operator is DataFrame -> DataFrame."""
