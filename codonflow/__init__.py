"""Transcript labelling and ORF annotation on Spark DataFrames."""
