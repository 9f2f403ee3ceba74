"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from linkatlas.plans import fetches, ledgers, outlines, pages, runs, scalars, sqlfuncs, streams, summaries, trees  # noqa: F401
from linkatlas.plans.registry import CHECKS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
