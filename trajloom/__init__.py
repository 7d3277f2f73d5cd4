"""PySpark-native engine for agent trajectories and training corpora."""
