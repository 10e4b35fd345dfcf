"""Declared schemas of the pitch table and the measurement log."""

from __future__ import annotations

from pyspark.sql import types as T

_INT, _DBL, _STR = T.IntegerType(), T.DoubleType(), T.StringType()
_RATES = ("success", "reverse", "middle", "ball", "strike", "fastball", "breaking", "offspeed")


def _struct(groups: list[tuple[T.DataType, list[str]]]) -> T.StructType:
    return T.StructType([T.StructField(c, t, True) for t, cols in groups for c in cols])


# Column names of the competition tables.
PITCHES = _struct([
    (_STR, ["row_id"]),
    (_INT, ["season", "game_month", "game_dayofweek", "inning"]),
    (_STR, ["top_bottom", "game_type", "base_state"]),
    (_INT, ["balls_before", "strikes_before", "outs_before", "run_top_before", "run_bot_before",
            "run_total_before", "score_diff_home", "score_diff_pitcher_team", "runner_on_1b",
            "runner_on_2b", "runner_on_3b", "num_runners_on"]),
    (_DBL, ["home_win_expectancy", "away_win_expectancy", "li"]),
    (_INT, ["pitcher_id", "batter_id", "pitcher_hand", "batter_hand", "pitcher_team_id", "batter_team_id",
            "asof_pitcher_n", "asof_batter_n", "asof_pitcher_pitchmix_n"]),
    (_DBL, [f"asof_pitcher_{r}_rate" for r in _RATES]
     + [f"asof_pitcher_prev{k}_game_{r}_rate" for k in (1, 3, 5) for r in ("success", "middle")]
     + ["asof_batter_success_rate", "asof_batter_middle_rate"]),
    (_INT, ["control_success"]),
])
