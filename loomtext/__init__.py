"""loomtext: corpus text analytics on Spark."""
