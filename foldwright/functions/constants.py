"""Fixed values that results depend on."""

# --- fixed values: task and metric codes -------------------------------------------------
TASK_CODES = {
    "binary.classification": 1,
    "multiclass.classification": 2,
    "multilabel.classification": 3,
    "regression": 4,
}
METRIC_CODES = {
    "acc": 5, "acc_metric": 5,
    "auc": 6, "auc_metric": 6,
    "bac": 7, "bac_metric": 7,
    "f1": 8, "f1_metric": 8,
    "pac": 9, "pac_metric": 9,
    "r2": 10, "r2_metric": 10,
    "a": 11, "a_metric": 11,
}
PROPERTY_CODES = {
    "dense": 5,
    "sparse": 6,
    "predictions": 7,
    "input": 8,
    "signed data": 9,
    "unsigned data": 10,
}

# --- fixed values: cost of a run that produced no result ---------------------------------
FAILED_COST = 1234567890.0

# --- fixed values: floor of every count in the balanced accuracy -------------------------
COUNT_FLOOR = 1e-15

# --- fixed values: codes of the one-hot encoder ------------------------------------------
CODE_OTHER = 1
CODE_MISSING = 2
CODE_SHIFT = 3

# --- fixed values: variance smoothing of the Gaussian model ------------------------------
GAUSSIAN_EPSILON = 1e-9

# --- fixed values: seconds a stage must take before its output is worth keeping ----------
MIN_STAGE_SECONDS = 1.0
