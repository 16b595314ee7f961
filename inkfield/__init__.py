"""Page-geometry and mathematical-structure analytics on Spark."""
