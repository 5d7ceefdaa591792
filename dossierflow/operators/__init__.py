"""The five stages as column builders and DataFrame transformations."""
