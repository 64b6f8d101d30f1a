"""Location-centred map-feature analytics on Spark."""
