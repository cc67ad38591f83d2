"""Rules over parsed pages: a registry of declared rules, their options and gates, and one pass that runs them all."""
