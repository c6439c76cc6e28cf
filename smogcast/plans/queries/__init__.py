"""Registered queries, one module per topic; importing a module registers its queries."""
