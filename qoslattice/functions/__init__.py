"""Column builders, rulesets and driver-side helpers."""
