"""barline: point-in-time analytics of daily market bars on Spark."""
