"""Multi-stage plans and the registered queries."""
