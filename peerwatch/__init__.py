"""Peer-group anomaly triage on Spark.

Every operator takes and returns Spark DataFrames; see README.md for the map.
"""
