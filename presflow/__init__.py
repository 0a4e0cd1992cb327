"""Presence analytics on Spark: detections, tracks, clusters, embeddings and time intervals as DataFrames."""
