"""Agent-telemetry analytics on Spark."""
