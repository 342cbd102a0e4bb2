"""Telemetry analytics for power plants, written as Spark DataFrame operators."""
