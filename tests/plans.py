"""Look at executed plans."""

from __future__ import annotations


def final_plan(df) -> str:
    """The physical plan after running, with what adaptive execution decided."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    return execution.executedPlan().toString()


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
