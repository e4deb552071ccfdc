"""Query builders, registered queries and the command line."""
