"""Registered queries on the driver's tables, each with the SQL it is checked against where SQL can say it."""
