"""Claim-risk analytics on Spark."""
