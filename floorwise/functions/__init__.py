"""See the package docstring of floorwise."""
