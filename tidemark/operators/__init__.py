"""Time-series operators."""
