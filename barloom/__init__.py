"""Daily-bar research on PySpark: validation, calendars, reconciliation, adjustment, features, portfolios."""
