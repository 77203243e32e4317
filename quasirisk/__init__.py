"""Re-identification risk of tables, measured and lowered on Spark."""

from quasirisk.operators.encode import category_codes, encode_categories
from quasirisk.operators.influence import column_influence, combination_contribution
from quasirisk.operators.infogain import (
    cell_information_gain,
    gain_long,
    gain_matrix,
    gain_summary,
    gain_totals,
    information_gain,
    personal_information_factor,
    row_gain,
)
from quasirisk.operators.mitigate import (
    AddNoise,
    CombineSelected,
    DropColumn,
    RemoveDecimals,
    RoundNearest,
    RoundUp,
    apply_recipe,
    combine_values,
    compare_versions,
    generalisation_tree,
    revert,
    suppress_above,
    suppress_rows,
)
from quasirisk.operators.outliers import boxplot_statistics, mad_outliers
from quasirisk.operators.recode import compose_history, generalisation_levels, history_table, recode
from quasirisk.operators.risk import collapse_table, k_anonymity, l_diversity, risk_summary, unique_rows
from quasirisk.operators.suda import (
    attribute_contributions,
    attribute_level_contributions,
    file_level_risk,
    minimal_sample_uniques,
    record_contributions,
    rounded,
    suda_record_table,
    suda_scores,
)
from quasirisk.plans.ids import with_content_key, with_row_id
from quasirisk.plans.quantile import approximate_percentiles
from quasirisk.session import build_session
from quasirisk.sources.profile import by_distinct, columns_of_kind, profile
from quasirisk.sources.tables import (
    combine_dictionary,
    describe_column,
    distinct_values,
    drop_columns,
    load_dictionary,
    load_parquet,
    load_table,
    nan_to_null,
    preview,
    project,
    sensitive_attribute,
    sort_table,
    trim_header,
)

__all__ = [name for name in dir() if not name.startswith("_")]
