"""DataFrame-to-DataFrame analytics for power networks, time series and entity resolution."""
