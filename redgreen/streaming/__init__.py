"""Detection that follows jobs as they land."""
