"""Log, training and intelligence readers; sinks; shared storage."""
