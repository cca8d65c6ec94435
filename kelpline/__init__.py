"""kelpline: time-stamped instrument telemetry on Spark DataFrames."""
