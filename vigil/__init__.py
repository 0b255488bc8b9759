"""Access-event analytics and corpus preparation as Spark DataFrame operators."""
