"""DataFrame-to-DataFrame operators; columns are passed by name."""
