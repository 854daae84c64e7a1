"""Predictive-maintenance analytics over server telemetry, as Spark jobs."""
