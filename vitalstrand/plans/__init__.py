"""Study pipeline and the registered queries."""
