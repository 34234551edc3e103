"""Jobs that join operators, and the registered queries."""
