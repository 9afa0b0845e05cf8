"""spruce: table profiling, repair, validation and chart data as Spark DataFrame operators."""

from .operators.categorical import (group_rare_categories, map_values, one_hot_encode, rare_categories,
                                    standardize, standardize_case, trim_whitespace)
from .operators.chartdata import (bar_aggregate, bar_grouped_long, bar_grouped_wide, box_outliers, box_stats,
                                  correlation_matrix, filter_domains, histogram, histogram_grouped, line_series,
                                  scatter_points)
from .operators.columns import create_formula_column, drop_columns, filter_dataframe, rename_columns
from .operators.convert import (clean_dirty_numeric, convert_to_categorical, convert_to_datetime,
                                convert_to_datetime_mixed, convert_to_numeric, convert_type)
from .operators.dedup import duplicate_groups, duplicate_occurrences, find_duplicates, remove_duplicates
from .operators.missing import drop_rows_with_nulls, drop_sparse_columns, fill_missing
from .operators.numeric import (bin_column, cap_outliers, cap_outliers_iqr, cap_outliers_zscore,
                                detect_outliers_iqr, detect_outliers_zscore, flag_outliers, min_max_scale,
                                remove_outlier_rows, treat_outliers, z_score_scale)
from .operators.profile import (before_after_describe, before_after_nulls, categorical_describe, column_profile,
                                dataset_context, distinct_values, duplicate_stats, head_preview, missing_bands,
                                missing_table, numeric_describe, overview, profile, sample_types, tail_preview,
                                top_values)
from .operators.validate import ValidationRule, validate_rules, violation_summary
from .plans.recipe import apply_step, audit_report, make_step, recipe_document, replay, undo
from .sources.io import blank_to_null, load_csv, load_json, read_table, write_csv

__all__ = [n for n in dir() if not n.startswith("_")]
