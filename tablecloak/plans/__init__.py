"""Multi-step jobs, the views over the test tables, and the registered queries."""
