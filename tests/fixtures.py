"""Inline test inputs (shapes in FIXTURES.md)."""

from __future__ import annotations

import copy
import json
from datetime import datetime, timedelta, timezone

UTC = timezone.utc


GAME = 48213
POLLED = datetime(2025, 4, 2, 18, 31, 7, tzinfo=UTC)
STARTS = datetime(2025, 4, 2, 17, 5, 0, tzinfo=UTC)

# One line per play event: (kind, number, index, seconds after the start or None, extras)
SPLITTER = {"details": {"type": {"code": "FS", "description": "Splitter"},
                        "call": {"code": "F", "description": "Foul"},
                        "isInPlay": False, "isStrike": True, "isBall": False},
            "count": {"balls": 2, "strikes": 1, "outs": 1},
            "pitchData": {"startSpeed": 88.25, "endSpeed": 80.5, "breaks": {"spinRate": 1411}},
            "venue": {"roof": "open"}}
BARE = {"details": {"type": {"code": "KN"}, "call": {"code": "D"}}, "count": {"outs": 0}}
PLAYS = [
    {"at_bat": 11, "inning": 2, "half": "Bottom", "batter": 70, "pitcher": 31, "events": [
        ("pitch", 4, 0, 65, SPLITTER), ("other", None, 1, 70, {}), ("pitch", 5, 2, 90, BARE),
        ("pitch", None, 6, 121, BARE)]},
    {"at_bat": None, "inning": 2, "half": "Bottom", "batter": 71, "pitcher": 31, "events": [
        ("pitch", 1, 0, 200, BARE)]},
    {"at_bat": 13, "inning": 3, "half": "Top", "batter": 72, "pitcher": 32, "events": [
        ("pitch", 2, 0, 260, {"pitchData": {"startSpeed": 61.0}}), ("unsaid", 3, 1, 270, BARE)]},
]


def _clock(seconds: int) -> str:
    return (STARTS + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def _event(kind, number, index, seconds, extras) -> dict:
    flag = {"pitch": {"isPitch": True}, "other": {"isPitch": False}, "unsaid": {}}[kind]
    named = {"pitchNumber": number, "index": index, "startTime": _clock(seconds)}
    return {**flag, **{k: v for k, v in named.items() if v is not None}, **copy.deepcopy(extras)}


def _play(play: dict) -> dict:
    about = {"atBatIndex": play["at_bat"], "inning": play["inning"], "halfInning": play["half"]}
    person = lambda role: {"id": play[role], "fullName": f"{role} {play[role]}"}
    return {"about": {k: v for k, v in about.items() if v is not None},
            "matchup": {"batter": person("batter"), "pitcher": person("pitcher")},
            "playEvents": [_event(*e) for e in play["events"]]}


def feed() -> dict:
    """One game of three plays over two innings, built from ``PLAYS``."""
    return {
        "gamePk": GAME,
        "metaData": {"timeStamp": POLLED.strftime("%Y-%m-%dT%H:%M:%S.000Z")},
        "gameData": {"game": {"pk": GAME}, "status": {"detailedState": "In Progress"},
                     "teams": {"home": {"name": "Harbor"}, "away": {"name": "Summit"}},
                     "datetime": {"dateTime": STARTS.strftime("%Y-%m-%dT%H:%M:%SZ")}},
        "liveData": {"linescore": {"currentInning": 3, "inningHalf": "Top",
                                   "teams": {"home": {"runs": 5}, "away": {"runs": 0}}},
                     "plays": {"allPlays": [_play(p) for p in PLAYS]}},
    }


def expected_pitches() -> list[tuple]:
    """(id, play position, event position) of the pitches that ``PLAYS`` describes."""
    return [(f"mlb:{GAME}:pitch:{p['at_bat']}:{e[2] if e[1] is None else e[1]}", i, j)
            for i, p in enumerate(PLAYS) if p["at_bat"] is not None
            for j, e in enumerate(p["events"]) if e[0] == "pitch"]


def naive(t: datetime) -> datetime:
    return t.replace(tzinfo=None)


def variant(**changes) -> dict:
    f = copy.deepcopy(feed())
    for path, value in changes.items():
        node = f
        keys = path.split("__")
        for k in keys[:-1]:
            node = node[int(k)] if isinstance(node, list) else node[k]
        last = keys[-1]
        if value is _DELETE:
            if isinstance(node, list):
                node.pop(int(last))
            else:
                node.pop(last, None)
        elif isinstance(node, list):
            node[int(last)] = value
        else:
            node[last] = value
    return f


_DELETE = object()
DELETE = _DELETE

NOW = datetime(2024, 7, 16, 0, 0, 0, tzinfo=UTC)


def docs_frame(spark, *feeds):
    rows = [(f"d{i}", json.dumps(f)) for i, f in enumerate(feeds)]
    return spark.createDataFrame(rows, "doc_id string, value string")


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC) if "+" not in text else \
        datetime.fromisoformat(text)
