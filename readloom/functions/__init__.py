"""Column functions; none of them runs an action."""
