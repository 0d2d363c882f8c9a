"""Grid-telemetry and incident analytics as PySpark DataFrame jobs."""
