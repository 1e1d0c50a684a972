"""Event intake, idempotent loading, analytics and transfer surveillance on Spark."""
