"""Procedure analytics on Spark: technical documents to steps, graphs, checks and reports, as DataFrames."""
