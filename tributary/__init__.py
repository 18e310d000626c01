"""Tributary: DataFrame operators for preparing and measuring language-model training data on Spark."""
