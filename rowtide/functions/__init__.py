"""Functions from columns to columns, and small aggregations."""
