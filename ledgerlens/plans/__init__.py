"""Named queries (the catalogue) and their oracle SQL."""
