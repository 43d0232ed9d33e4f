"""The given tables in the roles of the domain model, with their queries."""
