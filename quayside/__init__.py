"""Spark jobs for lakehouse, feature, monitoring and corpus work: plain functions from DataFrames to DataFrames."""
