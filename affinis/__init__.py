"""Similarity search, relevancy feedback and classification over feature vectors, planned as Spark DataFrames."""
