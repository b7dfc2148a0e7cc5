"""Distributed nonlinear least squares on Spark DataFrames."""
