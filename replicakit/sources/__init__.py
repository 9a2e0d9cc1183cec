"""replicakit.sources"""
