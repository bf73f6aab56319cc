import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from matchlake.session import get_session
    s = get_session("local[*]", shuffle_partitions=8)
    yield s


FACT_SCHEMA = ("match_id bigint, league_id int, season string, match_date date, match_status string, "
               "home_team_id int, home_team_name string, home_team_score int, away_team_id int, "
               "away_team_name string, away_team_score int")


def hand_made(spark):
    """8 entities x 24 finished events (positions 0-23 are the batches' targets).

    home = 100 + k % 8, away = 100 + (k % 8 + 1 + k // 8) % 8, match id = 1000 + k; entity 100
    plays more than 6 times, one entity has two events on one day, there are draws."""
    teams = [(100 + i, f"Team{i}") for i in range(8)]
    names = dict(teams)
    rows = []
    for k in range(24):
        h = 100 + k % 8
        a = 100 + (k % 8 + 1 + k // 8) % 8
        d = dt.date(2023, 8, 1) + dt.timedelta(days=k // 2)
        rows.append((1000 + k, 4328, "2023-2024", d, "Match Finished", h, names[h], k % 3, a, names[a], (k // 3) % 3))
    fct = spark.createDataFrame(rows, FACT_SCHEMA)
    dim = spark.createDataFrame(teams, "team_id int, team_name string")
    return {"fct_matches": fct, "dim_teams": dim}
