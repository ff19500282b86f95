"""Reading and writing events, alerts and dead letters."""
