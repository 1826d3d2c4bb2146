"""panelcast: feature engineering, exact splits, regression fitting and model
selection over a keyed daily panel ``(series, day, measures..., target)``,
expressed as Spark DataFrame plans.

Sub-packages
------------
sources    reading panels, the fixture panel built from the test tables, model I/O
functions  column-level transforms (calendar, cyclical, lag, scaling, polynomials, metrics)
operators  splits, moments / Gram matrices, linear / tree / network estimators, PCA,
           model selection, chart tables
plans      end-to-end studies and the registry of named queries
streaming  scoring of arriving records with a saved model
"""

__version__ = "0.1.0"
