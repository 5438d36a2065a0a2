"""Commands and the catalog that they are resolved against."""
