"""The reports, put together from the operators."""
