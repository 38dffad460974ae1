"""Moments and thresholds used on the given tables, shared by the queries and their SQL.

The library's defaults are the rules' own thresholds. The tables have far larger scores than those were made for, so some
queries use higher ones, at which some players or teams qualify and others do not.
"""

import datetime as dt

FIRST_DAY = dt.date(2024, 1, 1)
FIRST_HOUR = dt.datetime(2024, 1, 1)
AS_OF = dt.datetime(2024, 1, 25, 12)
NOW = dt.datetime(2024, 1, 30, 23, 30)  # within the last day of the entries
LATE_DAY = dt.date(2024, 1, 16)
ORDERS_AS_OF = dt.datetime(2001, 3, 15, 12)
CHRISTMAS = dt.datetime(1999, 12, 22, 12)

TEAMS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
OPEN_TEAMS = TEAMS[:4]  # where an allow-list should have something to reject
POOL = "MACHINERY"  # plays the pool of players without a team

PRAISE = ("signup",)
HARD = ("purchase",)
VOLUNTEER = ("view",)
REFEREE = ("1-urgent", "2-high")
LATENESS = ("1-urgent",)

MILESTONES = (500, 1000, 1500, 2000, 2500)
CURVE_DAYS = 14
WEEK_POINTS = 24000
MONTH_POINTS = 78000
UNITED_DAYS = 10
BALANCE = (450, 2700)
HARMONY_GAP = 2300
HARMONY_MONTH = 1
WEAK_LINK = 20
WEAK_LINK_DAYS = 18
TOP_DAYS = 3
VETERAN_DAYS = 5
COURAGE_COUNT = 2
OWN_BADGES = 6
TEAM_BADGES = 4
LEVEL = 300
LEVEL_DAYS = 7
SALT = "public-salt"
RENAME_OFFSET = 1_000_000
