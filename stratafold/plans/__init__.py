"""Plans built from the operators: feature sets, cross-validation, learners, experiment and run reports."""
