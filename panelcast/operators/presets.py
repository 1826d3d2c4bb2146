"""Named presets: the reference studies' model settings and search spaces.

Fixed values (they must equal the reference's for the same study), in the
reference's own parameter names; ``trees.BUILDERS`` maps them onto Spark.
``None`` means "no limit" / "all features".
"""

from __future__ import annotations

# --- fixed values: model comparison -------------------------------------
COMPARE_BOOST = {"n_estimators": 300, "max_depth": 3, "learning_rate": 0.01, "subsample": 1.0,
                 "colsample_bytree": 0.8, "reg_alpha": 0.1, "reg_lambda": 1.5}
COMPARE_FOREST = {"n_estimators": 300, "max_depth": 10}
COMPARE_BOOST_LEAFWISE = {"n_estimators": 500, "learning_rate": 0.05, "num_leaves": 31, "subsample": 0.8,
                          "colsample_bytree": 0.8}
COMPARE_NETWORK = {"hidden": [128, 64], "l2": [1e-4, 1e-4], "learning_rate": 1e-3, "epochs": 500}
COMPARE_DEGREE = 2          # expansion for least squares; trees and boosting use degree 1
FOLDS = 5
HOLDOUT = 0.3
SEED = 42
STABILITY_LIMIT = 0.05

# --- fixed values: decision-tree grid -------------------------------------
TREE_GRID = {"max_depth": [5, 10, 15, 20, None], "min_samples_leaf": [1, 2, 5, 10]}

# --- fixed values: forest grid --------------------------------------------
FOREST_GRID = {"n_estimators": [100, 200, 300], "max_depth": [10, 20, 30, None],
               "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 5],
               "max_features": ["sqrt", "log2", None]}

# --- fixed values: boosting on a log target, grid ---------------------------
# (the reference's library stops at 31 leaves and 20 rows a leaf unless told otherwise)
BOOST_LOG_GRID = {"num_leaves": [31], "min_samples_leaf": [20],
                  "n_estimators": [100, 200, 300], "max_depth": [3, 5, 7, 9],
                  "learning_rate": [0.01, 0.05, 0.1, 0.2], "subsample": [0.8, 1.0],
                  "colsample_bytree": [0.8, 1.0]}

# --- fixed values: boosting, random search (50 draws) -----------------------
BOOST_SPACE = {"n_estimators": [100, 300, 500], "max_depth": [3, 5, 7, 10],
               "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.7, 0.8, 0.9, 1.0],
               "colsample_bytree": [0.7, 0.8, 0.9, 1.0], "reg_alpha": [0, 0.01, 0.1],
               "reg_lambda": [1, 1.5, 2]}
BOOST_DRAWS = 50

# --- fixed values: linear study -----------------------------------------
LINEAR_DEGREE = 3           # interactions only, with bias
# penalties: ten values evenly spaced in log scale from 1e-3 to 1e3 (linear.REFERENCE_ALPHAS)

# --- fixed values: network study ------------------------------------------
NETWORK_TRIALS = 25
NETWORK_EPOCHS = 400
NETWORK_VALIDATION = 0.2
# search space: mlp.SPACE; early stopping patience 30, rate halved after 10, floor 1e-5 (MLPConfig)
