"""talentspark sources."""
