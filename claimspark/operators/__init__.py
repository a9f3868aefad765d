"""Generic DataFrame operators: they take frames and column names, not the
claims schema, and are composed into the claims plans in ``claimspark.plans``."""

from claimspark.operators.aggregates import (  # noqa: F401
    class_balance, conditional_profile, grid_counts, monthly_counts, period_profile,
    rate_by, sum_by, value_counts,
)
from claimspark.operators.evaluation import (  # noqa: F401
    auc, classification_report, confusion_counts, confusion_matrix, roc_points, score_table,
)
from claimspark.operators.histogram import histogram  # noqa: F401
from claimspark.operators.outliers import group_mean, ratio_outliers  # noqa: F401
from claimspark.operators.pairs import near_pairs  # noqa: F401
from claimspark.operators.quality import (  # noqa: F401
    key_report, key_violations, orphan_count, orphan_report, orphans,
)
from claimspark.operators.ranking import (  # noqa: F401
    exclusive_prefix, global_rank, range_partitioned, sequential_ids, top_k, value_counts_ranked,
)
from claimspark.operators.sampling import exact_stratified_split, hash_sample, hash_split  # noqa: F401
from claimspark.operators.sweep import sweep_pairs  # noqa: F401
