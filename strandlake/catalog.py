"""All registered queries of the library's own operators, with the SQL that each must agree with."""

from __future__ import annotations

from strandlake.plans import base
from strandlake.plans import audits, channel, codec, errors, files, probes, relational, reports, sequence, statistics, streams, verdicts  # noqa: F401  register queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
