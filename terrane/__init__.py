"""Survey analytics on Spark: intervals, geometry, reports, registers, graphs and rasters as DataFrame operators."""
