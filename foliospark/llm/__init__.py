"""Training-data operators. Nothing outside this folder imports it (but for the guarded entry point)."""
