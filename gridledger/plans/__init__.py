"""Named questions, each with the SQL it must agree with."""
