"""talentspark functions."""
