"""Named queries, their SQL twins, and plan helpers (session, scratch tables)."""
