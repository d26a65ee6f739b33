"""jobscope: Spark operators over the telemetry of compute-job fleets."""
