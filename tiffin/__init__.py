"""Tiffin: canteen and food-ordering analytics as PySpark DataFrame jobs."""
