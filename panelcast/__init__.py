"""panelcast: panels of time series as Spark DataFrame operators."""
