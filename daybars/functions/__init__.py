from daybars.functions.parse import (  # noqa: F401
    format_yyyymmdd, int_or_zero, num_or_zero, parse_yyyymmdd, utrim,
)
from daybars.functions.rates import pct_change  # noqa: F401
