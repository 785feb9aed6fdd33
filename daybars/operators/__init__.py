from daybars.operators.aggregates import (  # noqa: F401
    code_status, collected_range, count_by_market, latest_bar, market_counts_wide, run_summary,
)
from daybars.operators.features import (  # noqa: F401
    features_as_of, features_full, features_touched, prev_bar, touched_months, with_previous,
)
from daybars.operators.integrity import (  # noqa: F401
    duplicate_keys, fk_orphans, fk_valid, quality_report,
)
from daybars.operators.keyed import cascade_delete, keep_last, upsert, upsert_with_audit  # noqa: F401
from daybars.operators.lookup import find_code, lookup_bars  # noqa: F401
from daybars.operators.planner import (  # noqa: F401
    check_days, gap_windows, plan_full, plan_gaps, plan_incremental, plan_initial, plan_mode_counts,
    plan_modes,
)
