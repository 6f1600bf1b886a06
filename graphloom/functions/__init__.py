"""Term functions: plan-time template parsers and Catalyst column expressions."""
