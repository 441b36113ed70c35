"""See the README for the package layout."""
