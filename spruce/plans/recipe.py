"""Recipes: an ordered list of named steps, replayed as one lazy chain of DataFrame transforms.

A step is ``{"operation": name, "params": {...}, "columns": [...]}``.  The
recipe is the log: undo is replay without the last step, reset is the
source table.  Replay builds one plan (Catalyst collapses the projections);
``checkpoint_every`` writes the intermediate to the shared checkpoint
directory to cut long lineages.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from ..operators import categorical, columns as colops, convert, dedup, missing, numeric
from ..session import ensure_checkpoint_dir
from .observe import Watch

RECIPE_VERSION = "1.0"


# The parameter names a recipe may hold, by operation (columns / column everywhere).
PARAMETERS = {
    "fill_missing": ["strategy", "constant", "order_by", "partition_by", "exact", "threshold"],
    "remove_duplicates": ["subset", "keep", "order_by"],
    "convert_type": ["target", "format", "order_by"],
    "standardize_categorical": ["operations"],
    "outlier_treatment": ["method", "action", "factor", "threshold"],
    "scale_columns": ["method"],
    "scale_min_max": ["method"],
    "scale_z_score": ["method"],
    "drop_columns": [],
    "rename_column": ["mapping", "old", "new"],
    "one_hot_encode": ["drop_first", "max_values"],
    "group_rare": ["threshold", "replacement"],
    "map_values": ["mapping", "set_unmatched_to_other", "other"],
    "create_column": ["name", "new_name", "formula"],
    "bin_column": ["n_bins", "bins", "method", "labels"],
    "drop_rows": [],
    "drop_columns_by_threshold": ["threshold"],
}


def _cols(step: dict) -> list[str]:
    p = step.get("params") or {}
    cols = p.get("columns", step.get("columns") or step.get("affected_columns") or [])
    return [cols] if isinstance(cols, str) else list(cols)


def _one_col(step: dict) -> str:
    p = step.get("params") or {}
    if p.get("column"):
        return p["column"]
    cols = step.get("columns") or step.get("affected_columns") or []
    return cols[0] if cols else ""


def _fill(df, s):
    p = s.get("params") or {}
    if str(p.get("strategy", "")).lower() == "drop_columns_by_threshold":
        return _drop_sparse(df, s)
    return missing.fill_missing(df, _cols(s), p.get("strategy", "mean"), constant=p.get("constant"),
                                order_by=p.get("order_by"), partition_by=p.get("partition_by"),
                                exact=p.get("exact", True))


def _dedup(df, s):
    p = s.get("params") or {}
    return dedup.remove_duplicates(df, subset=p.get("subset"), keep=p.get("keep", "first"),
                                   order_by=p.get("order_by"))


def _convert(df, s):
    p = s.get("params") or {}
    return convert.convert_type(df, _cols(s), p.get("target", "numeric"), fmt=p.get("format"),
                                order_by=p.get("order_by"))


def _standardize(df, s):
    p = s.get("params") or {}
    return categorical.standardize(df, _cols(s), p.get("operations", ["trim", "lower"]))


def _outliers(df, s):
    p = s.get("params") or {}
    return numeric.treat_outliers(df, _cols(s), p.get("method", "IQR"), p.get("action", "Cap"),
                                  p.get("factor", 1.5), p.get("threshold", 3.0))


def _scale(df, s):
    p = s.get("params") or {}
    op = s["operation"]
    method = {"scale_min_max": "min_max", "scale_z_score": "z_score"}.get(op, p.get("method", "min_max"))
    method = method.lower().replace("-", "_")
    if method in ("min_max", "minmax"):
        return numeric.min_max_scale(df, _cols(s))
    return numeric.z_score_scale(df, _cols(s))


def _rename(df, s):
    p = s.get("params") or {}
    mapping = p.get("mapping") or {p.get("old", ""): p.get("new", "")}
    return colops.rename_columns(df, mapping)


def _one_hot(df, s):
    p = s.get("params") or {}
    return categorical.one_hot_encode(df, _cols(s), p.get("drop_first", False), p.get("max_values"))


def _group_rare(df, s):
    p = s.get("params") or {}
    return categorical.group_rare_categories(df, _one_col(s), p.get("threshold", 5),
                                             p.get("replacement", "Other"))


def _map_values(df, s):
    p = s.get("params") or {}
    return categorical.map_values(df, _one_col(s), p.get("mapping", {}),
                                  p.get("set_unmatched_to_other", p.get("other", False)))


def _create(df, s):
    p = s.get("params") or {}
    return colops.create_formula_column(df, p.get("name") or p.get("new_name"), p["formula"])


def _bin(df, s):
    p = s.get("params") or {}
    return numeric.bin_column(df, _one_col(s), p.get("n_bins", p.get("bins", 5)), p.get("method", "equal_width"),
                              p.get("labels"))


def _drop_rows(df, s):
    return missing.drop_rows_with_nulls(df, _cols(s) or None)


def _drop_sparse(df, s):
    p = s.get("params") or {}
    return missing.drop_sparse_columns(df, p.get("threshold", 50))


def _drop_cols(df, s):
    return colops.drop_columns(df, _cols(s))


# Operation name -> step function (the names a recipe may hold).
STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "fill_missing": _fill,
    "remove_duplicates": _dedup,
    "convert_type": _convert,
    "standardize_categorical": _standardize,
    "outlier_treatment": _outliers,
    "scale_columns": _scale,
    "scale_min_max": _scale,
    "scale_z_score": _scale,
    "drop_columns": _drop_cols,
    "rename_column": _rename,
    "one_hot_encode": _one_hot,
    "group_rare": _group_rare,
    "map_values": _map_values,
    "create_column": _create,
    "bin_column": _bin,
    "drop_rows": _drop_rows,
    "drop_columns_by_threshold": _drop_sparse,
}


def apply_step(df: DataFrame, step: dict) -> DataFrame:
    """One named step; an unknown name or parameter is an error."""
    op = step.get("operation")
    fn = STEPS.get(op)
    if fn is None:
        raise ValueError(f"Unknown operation: {op}")
    unknown = set(step.get("params") or {}) - {"columns", "column", *PARAMETERS[op]}
    if unknown:
        raise ValueError(f"Unknown parameters of {op}: {sorted(unknown)}")
    return fn(df, step)


def replay(df: DataFrame, steps: Sequence[dict], checkpoint_every: int | None = None) -> DataFrame:
    """R2: apply the steps in order."""
    out = df
    for i, step in enumerate(steps, 1):
        out = apply_step(out, step)
        if checkpoint_every and i % checkpoint_every == 0 and i < len(steps):
            ensure_checkpoint_dir(out.sparkSession)
            out = out.checkpoint(eager=True)
    return out


def undo(source: DataFrame, steps: Sequence[dict]) -> tuple[DataFrame, list[dict]]:
    """Undo the last step: replay all but the last on the source."""
    kept = list(steps)[:-1]
    return replay(source, kept), kept


def make_step(operation: str, params: dict | None = None, columns: Iterable[str] | None = None) -> dict:
    if operation not in STEPS:
        raise ValueError(f"Unknown operation: {operation}")
    return {"operation": operation, "params": dict(params or {}), "columns": list(columns or [])}


def recipe_document(steps: Sequence[dict]) -> dict:
    """{version, generated_at, steps: [{operation, params, columns}]}."""
    return {"version": RECIPE_VERSION, "generated_at": datetime.now().isoformat(),
            "steps": [{"operation": s.get("operation"), "params": s.get("params", {}),
                       "columns": s.get("columns", [])} for s in steps]}


def recipe_to_json(steps: Sequence[dict]) -> str:
    return json.dumps(recipe_document(steps), indent=2, default=str)


def recipe_from_json(text: str) -> list[dict]:
    doc = json.loads(text)
    steps = doc.get("steps") if isinstance(doc, dict) else doc
    return [make_step(s["operation"], s.get("params"), s.get("columns")) for s in steps]


AUDIT = ("step int, operation string, rows_before long, rows_after long, columns_before int, columns_after int, missing_cells_before long, "
         "missing_cells_after long, column_names_before string, column_names_after string")


def audit_report(source: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """One row per step with rows / columns / missing cells before and after it.

    The counts are observed while the chain runs: steps that work row by row are one run together, a step
    that reads its input more than once starts from its written input (see ``observe``).
    """
    watch = Watch(source)
    for s in steps:
        watch.step(lambda df, s=s: apply_step(df, s))
    counts = watch.results()
    rows = [(i, s["operation"], counts[i - 1][0], counts[i][0], len(watch.columns[i - 1]), len(watch.columns[i]), counts[i - 1][1],
             counts[i][1], ",".join(watch.columns[i - 1]), ",".join(watch.columns[i])) for i, s in enumerate(steps, 1)]
    return source.sparkSession.createDataFrame(rows, AUDIT)
