"""Session analytics and next-item recommendation as Spark DataFrame plans."""
