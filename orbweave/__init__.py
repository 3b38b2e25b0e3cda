"""Event-window analytics over multi-sensor trajectories, as Spark DataFrame operators."""
