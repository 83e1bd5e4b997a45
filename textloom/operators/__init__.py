"""DataFrame operators: correction, coverage gates, layout, turns and alignment, images, catalog."""
