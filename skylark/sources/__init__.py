"""sources of the package."""
