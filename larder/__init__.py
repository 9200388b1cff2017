"""Prep-demand and food-cost analytics for many restaurants at once, as Spark DataFrame jobs."""
