"""Filters, annotations, strata, projection, pairs and spectrum algebra."""
