"""Early-signal analytics on public-register filings, as Spark jobs."""
