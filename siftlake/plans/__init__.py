"""Views that give the driver's tables OCSF shape, and the catalogue of runnable queries."""
