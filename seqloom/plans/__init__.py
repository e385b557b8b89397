"""Plan helpers: stage tables and loops."""
