"""replicakit.operators"""
