"""Catalogue, model-sample, light-curve and spectrum analytics on Spark DataFrames."""
