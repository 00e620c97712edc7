"""DataFrame → DataFrame operators (lists, roll-ups, change application, audits)."""
