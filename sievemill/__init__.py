"""sievemill: post-training data analytics on Spark, as DataFrame to DataFrame functions."""
