"""Jobs that combine operators: models, cross-validation, tuning, configuration search and phases."""
