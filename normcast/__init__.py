"""normcast: behavioural anomaly analytics and training-data preparation as lazy Spark DataFrame plans."""
