"""Row-level scope by state (q09, q10, q22).

A user either sees every state (the board, or the 'Todos' choice) or one state. Billing rows
are kept when their state equals the chosen one ignoring case; demand rows are kept when
their client was billed in that state (a semi join on the cleaned client key - the demand's
own state column is not used, as upstream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import clean_key
from ledgerlens.plans.broadcast import broadcast_if_bounded

# The two choices that mean "no state restriction".
ALL_STATES = "Todos"
BOARD_USER = "DIRETORIA"


class OwnState(str):
    """The state that a user is fixed to. It restricts whatever it is called, so that no user name
    can lift the scope."""


def is_unrestricted(state: str | None) -> bool:
    """No state, or one of the two choices that mean all (white space around them doesn't count)."""
    return state is None or (not isinstance(state, OwnState) and str(state).strip().upper() in (ALL_STATES.upper(), BOARD_USER))


def permitted_state(username: str, chosen: str | None = None) -> str | None:
    """The board chooses freely (None = all); any other user is fixed to its own state."""
    if username.upper() == BOARD_USER:
        return None if is_unrestricted(chosen) else chosen
    return OwnState(username)


def scope_billing(billing: DataFrame, state: str | None) -> DataFrame:
    """q09: billing rows of one state (case-insensitive); all rows when unrestricted."""
    if is_unrestricted(state):
        return billing
    return billing.where(F.upper(F.col("state")) == F.lit(str(state).upper()))


def scope_demand(demand: DataFrame, scoped_billing: DataFrame, state: str | None) -> DataFrame:
    """q10: demand rows whose cleaned client key occurs in the scoped billing."""
    if is_unrestricted(state):
        return demand
    keys = broadcast_if_bounded(
        scoped_billing.select(clean_key("client_key").alias("_k")).distinct())
    return (demand.withColumn("_k", clean_key("client_key"))
            .join(keys, "_k", "left_semi").drop("_k"))


def state_list(billing: DataFrame) -> DataFrame:
    """q22: the choices offered to the board: 'Todos' first (pos 0), then the sorted states (pos 1)."""
    first = billing.sparkSession.range(1).select(F.lit(ALL_STATES).alias("state"), F.lit(0).alias("pos"))
    states = (billing.where(F.col("state").isNotNull()).select("state").distinct()
              .withColumn("pos", F.lit(1)))
    return first.unionByName(states).orderBy("pos", "state")


def states_offered(billing: DataFrame, state: str | None) -> DataFrame:
    """The choices offered to a user: all of them (``state_list``), or only the state of its scope."""
    if is_unrestricted(state):
        return state_list(billing)
    return billing.sparkSession.range(1).select(F.lit(str(state)).alias("state"), F.lit(1).alias("pos"))


def scope(billing: DataFrame, demand: DataFrame, state: str | None) -> tuple[DataFrame, DataFrame]:
    """Both inputs restricted to what a user of ``state`` may see (unchanged when unrestricted)."""
    b = scope_billing(billing, state)
    return b, scope_demand(demand, b, state)
