"""replicakit.streaming"""
