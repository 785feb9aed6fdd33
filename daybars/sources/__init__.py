from daybars.sources.master_text import (  # noqa: F401
    parse_master_lines, read_master_text, read_master_zip, read_masters, split_master_lines,
    union_markets,
)
from daybars.sources.quotes import parse_quotes, read_quotes, split_quotes  # noqa: F401
from daybars.sources.tables import (  # noqa: F401
    merge_latest, merge_months, read_months, read_table, refresh_feature_months, write_months, write_table,
)
