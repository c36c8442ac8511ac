"""Remote host texts ``host:user[:key]``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv


def parse_remote_hosts(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Host, SSH user and key path; ``error`` when there are fewer than two parts.

    The text is split at every ``:``. Parts after the third are dropped, which ``extra_parts``
    reports.
    """
    parts = F.split(column, ":")
    valid = F.size(parts) >= 2
    return specs.withColumns(
        {
            "host": F.when(valid, F.try_element_at(parts, F.lit(1))),
            "ssh_user": F.when(valid, F.try_element_at(parts, F.lit(2))),
            "ssh_key_path": F.when(valid, F.try_element_at(parts, F.lit(3))),
            "extra_parts": F.greatest(F.size(parts) - 3, F.lit(0)),
            "error": F.when(~valid, F.format_string(fv.MSG_BAD_REMOTE_HOST, column)),
        }
    )
