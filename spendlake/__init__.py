"""spendlake: company expense analytics as Spark DataFrame operators."""
