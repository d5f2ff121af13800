"""Offer aggregation on Spark: feeds, pages, snapshots, listings and control decisions as DataFrame jobs."""
