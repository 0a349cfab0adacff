"""Reading audit logs and rules, reading and writing snapshots."""
