"""inundata: flood mapping from radar image time series, as Spark jobs."""
