"""Forecast data pipelines for many-site 15-minute readings, as Spark jobs."""
