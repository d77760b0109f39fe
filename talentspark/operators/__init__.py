"""talentspark operators."""
