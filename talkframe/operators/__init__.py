"""DataFrame operators over the canonical turn table."""
