"""DataFrame jobs for the catalog of a large fleet of deployed services."""
