"""Sources and sinks: sales files, the star schema, result files, saved models."""
