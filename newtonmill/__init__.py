"""PySpark-native engine for distributed second-order training and analysis of logistic models."""
