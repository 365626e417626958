"""Wayfold: trajectory and sensor-fusion analytics declared as Spark jobs."""
