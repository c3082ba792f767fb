"""Session set-up, lineage cuts and the registered queries."""
