"""Queries: boosted trees over listing features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import dates
from tablewright.operators import encoding as e
from tablewright.operators import groups as g
from tablewright.operators import model
from tablewright.plans.history import BASELINE_RMSE, baseline_rmse
from tablewright.plans.registry import Tables, query, rounded
from tablewright.session import fresh_path, materialize

CATEGORICAL = ("region", "city", "category_name", "parent_category_name", "activation_weekday")
NUMERIC = ("days", "ave_days_up_user", "avg_times_up_user", "n_user_items", "region_dp_mean", "region_dp_std")
PARAMS = {"maxIter": 12, "maxDepth": 4, "stepSize": 0.2, "maxBins": 64}


def _fitted(t: Tables):
    """Model and the assembled table, with the test rows flagged."""
    items = t.items
    dictionary = materialize(e.label_dictionary([items], CATEGORICAL[:4]), "codes")
    dated = items.withColumns({
        "activation_weekday": dates.weekday("activation_date"), "days": dates.days_since("activation_date"),
    })
    # A share of the training rows alone is held out, and statistics of the target know only the others.
    train = model.holdout(dated.where("is_train"), "item_id", 0.15, seed=1, name="is_valid")
    both = materialize(train.unionByName(dated.where("not is_train").withColumn("is_valid", F.lit(False))), "split")
    listed = g.listing_features(both, t.periods, items)
    encoded = g.target_encode(both.where("is_train and not is_valid"), listed, ["region"], "price", on_missing="null")
    coded = e.apply_dictionary(encoded, dictionary, CATEGORICAL[:4])
    matrix = model.design_matrix(coded, [*CATEGORICAL, *NUMERIC], CATEGORICAL)
    stored = materialize(matrix.select("item_id", "price", "is_train", "is_valid", "features"), "matrix")
    fitted = model.fit_gbt(stored.where("is_train"), "price", "is_valid", PARAMS)
    return fitted, stored


@query("gbt_predict")
def gbt_predict(t: Tables):
    fitted, table = _fitted(t)
    return rounded(model.predict(fitted, table.where("not is_train"), "item_id"), 4)


@query("gbt_rmse")
def gbt_rmse(t: Tables):
    fitted, table = _fitted(t)
    test = table.where("not is_train")
    pairs = model.evaluate(model.predict(fitted, test, "item_id"), test, "item_id", target="price")
    return rounded(model.rmse(pairs), 4)


@query("feature_importance")
def feature_importance(t: Tables):
    fitted, _ = _fitted(t)
    return rounded(model.importances(t.spark, fitted, [*CATEGORICAL, *NUMERIC]))


@query("model_record", f"""SELECT 'parameter' AS kind, name, CAST(value AS DOUBLE) AS value
FROM (VALUES {', '.join(f"('{n}', {v})" for n, v in PARAMS.items())}) p(name, value)
UNION ALL SELECT 'score', 'baseline_rmse', rmse FROM ({BASELINE_RMSE})""")
def model_record(t: Tables):
    """Parameters, and the score of the baseline that a model has to beat, stored and read back."""
    score = baseline_rmse(t).first()["rmse"]
    path = model.write_record(t.spark, fresh_path(t.spark, "record"), PARAMS, {"baseline_rmse": score})
    return model.read_record(t.spark, path)
