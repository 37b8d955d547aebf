"""Asset telemetry, alerts and ontology queries as ordinary Spark DataFrames."""
