"""Spark jobs for regional statistics: panels, classes, trends and tile cartograms."""
