"""Whole queries: the Nexmark suite and the catalog of registered queries with their SQL."""
