"""talentspark: talent analytics as composable Spark DataFrame operators."""
