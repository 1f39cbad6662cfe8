"""Plans composed from the operators, and the queries on the driver's tables."""
