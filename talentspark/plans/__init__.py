"""talentspark plans."""
