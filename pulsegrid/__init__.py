"""Signal analytics on Spark: samples, beats, events and intervals as DataFrames."""
