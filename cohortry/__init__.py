"""Segmentation analytics and corpus preparation on Spark."""
