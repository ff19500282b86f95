"""Session settings, skew helpers and the registered queries."""
