"""Model names and the marks of significance, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The levels of significance.
LEVELS = ((0.01, "***"), (0.05, "**"), (0.10, "*"))


def family(model: Column) -> Column:
    """The name without its last part."""
    return F.when(model.contains("-"), F.regexp_extract(model, r"^(.*)-[^-]*$", 1)).otherwise(model)


def base_model(model: Column) -> Column:
    """The classical model inside a hybrid's name; empty for other names."""
    return F.regexp_extract(model, r"^[^-]+-(.*)-[^-]+$", 1)


def group(model: Column) -> Column:
    """The label of a model's kind, told by its learner's prefix and its hybrid mode."""
    out = F.lit("GARCH")
    for learner in ("LSTM", "XGB"):
        kind = F.when(model.contains("-feat"), f"{learner} Hybrid (features)").when(model.contains("-resid"), f"{learner} Hybrid (residual)").otherwise(f"Standalone {learner}")
        out = F.when(model.startswith(f"{learner}-"), kind).otherwise(out)
    return out


def stars(p: Column) -> Column:
    out = F.when(p.isNull() | F.isnan(p), "")
    for level, mark in LEVELS:
        out = out.when(p < level, mark)
    return out.otherwise("")
