"""File contracts, delivery registry and staging."""
