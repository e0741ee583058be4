"""Column helpers shared by the jobs. All are native column expressions."""
