"""Annotation evaluation and text-corpus analytics on Spark DataFrames."""
