"""Analytics built from several operators: curves, sweeps, evidence checks."""
