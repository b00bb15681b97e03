"""wayline: telemetry and training-data operators as plain functions from DataFrames to DataFrames."""
