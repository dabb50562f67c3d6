"""fleetlens: analytics over the telemetry of a fleet of served models, on Spark."""
