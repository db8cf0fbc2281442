"""tickweave: Spark-native estimation of volatilities, correlations and covariances from tick data."""

__version__ = "0.1.0"
