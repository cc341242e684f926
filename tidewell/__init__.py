"""Tidewell: an analytics engine for episode, annotation and text data, built on PySpark DataFrames."""
