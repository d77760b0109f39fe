"""talentspark streaming."""
