"""Sensor-network analytics and short-term forecasting as Spark DataFrame operators."""
