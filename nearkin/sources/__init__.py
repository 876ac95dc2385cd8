"""Sources: where photos come from."""
