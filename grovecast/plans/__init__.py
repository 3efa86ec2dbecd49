"""User-level plans: predictions, reports, current conditions, model fit, registered queries."""
