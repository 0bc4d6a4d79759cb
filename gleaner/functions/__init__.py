"""Package of DataFrame operators; see the README for an overview."""
