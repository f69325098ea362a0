"""Page extraction, verification, evaluation and run telemetry as Spark DataFrames."""
