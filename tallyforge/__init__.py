"""Settlement reconciliation and the analytics around it, as Spark DataFrame functions."""
