"""Rule table and registered queries."""
