"""Set-oriented analytics of company financial statements on Spark."""
