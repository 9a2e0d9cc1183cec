"""replicakit.plans"""
