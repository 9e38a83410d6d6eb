"""Spark jobs over large collections of event-annotated time series."""
