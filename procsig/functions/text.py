"""feature name -> readable text, as one column expression (and its SQL twin).

Derived feature names follow ``{base}_lag_{k}``, ``{base}_rolling_{stat}_{w}`` and
``{base}_diff``; anything else is a base variable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words used for each rolling statistic.
STAT_WORDS = {"mean": "average", "std": "standard deviation", "min": "minimum", "max": "maximum"}

_LAG = r"_lag_(-?[0-9]+)$"
_ROLL = r"_rolling_(mean|std|min|max)_([0-9]+)$"


def feature_description_expr(feature: Column, base_description: Column) -> Column:
    stat = F.regexp_extract(feature, _ROLL, 1)
    word = F.coalesce(*[F.when(stat == k, F.lit(v)) for k, v in STAT_WORDS.items()], stat)
    return (F.when(feature.rlike(_LAG), F.concat(base_description, F.lit(", lagged by "),
                                                 F.regexp_extract(feature, _LAG, 1), F.lit(" steps")))
            .when(feature.rlike(_ROLL), F.concat(base_description, F.lit(", rolling "), word, F.lit(", window="),
                                                 F.regexp_extract(feature, _ROLL, 2)))
            .when(feature.endswith("_diff"), F.concat(base_description, F.lit(", first difference")))
            .otherwise(base_description))


def feature_description_sql(feature: str, base_description: str) -> str:
    word = "CASE regexp_extract({f}, '{r}', 1) ".format(f=feature, r=_ROLL) + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in STAT_WORDS.items()) + f" ELSE regexp_extract({feature}, '{_ROLL}', 1) END"
    return (f"CASE WHEN regexp_matches({feature}, '{_LAG}') THEN {base_description} || ', lagged by ' || "
            f"regexp_extract({feature}, '{_LAG}', 1) || ' steps' "
            f"WHEN regexp_matches({feature}, '{_ROLL}') THEN {base_description} || ', rolling ' || {word} || ', window=' || "
            f"regexp_extract({feature}, '{_ROLL}', 2) "
            f"WHEN suffix({feature}, '_diff') THEN {base_description} || ', first difference' "
            f"ELSE {base_description} END")
