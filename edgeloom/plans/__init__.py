"""Query plans: canned views, ad-hoc questions and the driver's query registry."""
