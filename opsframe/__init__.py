"""Operations analytics over database and server telemetry, as Spark jobs.

Every job takes DataFrames (and an explicit ``as_of`` time where the clock
matters) and returns a lazy DataFrame.
"""

from opsframe.session import get_session

__all__ = ["get_session"]
