"""Complete reductions, one module per task."""
