"""Reading and writing readings, statistics, models and results."""
