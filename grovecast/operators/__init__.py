"""DataFrame operators: windows, features, scoring, risk, foliar advice, keep-first merge."""
