"""Frame facade, the typed projection and the query catalogue."""
