"""Jobs: one module per layer, plus ad-hoc SQL and the fraud model."""
