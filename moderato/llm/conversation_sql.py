"""DuckDB SQL for operator 11's query: the damage, the faults, and the cheapest
repair as a recursion over the turns with (cost, audit, text) for each of the four states.

With these costs a repair never gains by inserting: a turn beside the inserted one
can be deleted for 2, or it and its neighbour get other roles for 1 each, so
the recursion keeps, reroles or deletes."""

from __future__ import annotations

import zlib

#: CRC-32 register after one byte, from the rule: zlib's value of that byte, without its first and last inversion.
_TABLE = ", ".join(str(zlib.crc32(bytes([b ^ 0xFF]), 0) ^ 0xFF000000) for b in range(256))
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _crc(key: str) -> str:
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({key}, ''), lambda c: ascii(c)::BIGINT), "
            f"lambda a, b: xor(a >> 8, ([{_TABLE}]::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295)")


def _way(state: str, cost: str, letter: str, line: str | None) -> str:
    text = f"{state}.text" if line is None else f"list_append({state}.text, {line})"
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'text': {text}}}"


_KEEP, _USER, _HELP = "role || ':' || text", "'user:' || text", "'assistant:' || text"
_WAYS = {  # state reached: from each state, the letter, its cost (None: must hold `ok`), the role's initial and the line
    0: [("p0", "D", None, None)],
    1: [("p1", "D", None, None), ("p0", "K", "s", _KEEP)],
    2: [("p2", "D", None, None)] + [x for p in ("p0", "p1", "p3") for x in ((p, "K", "u", _KEEP), (p, "R", "", _USER))],
    3: [("p3", "D", None, None), ("p2", "K", "a", _KEEP), ("p2", "R", "", _HELP)],
}


def _best(state: int) -> str:
    ways = []
    for p, letter, initial, line in _WAYS[state]:
        cost = {"D": "2", "K": "cut", "R": "cut + 1"}[letter]
        holds = f"{p} IS NOT NULL" + ("" if letter == "D" else " AND NOT bad") + (f" AND initial = '{initial}'" if initial else "")
        ways.append(f"CASE WHEN {holds} THEN {_way(p, cost, letter, line)} END")
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1] AS p{state}"


_STATE = "STRUCT(cost BIGINT, audit VARCHAR, text VARCHAR[])"

OP11_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE kind <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         right(rtrim(text, {_SPACE}), 1) AS last, left(role, 1) AS initial
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt)),
faults AS (
  SELECT *, last = '' AS blank, last <> '' AND again AS repeated, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS short,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS odd
  FROM placed),
turns AS (SELECT *, blank OR repeated AS bad, CASE WHEN short THEN 5 ELSE 0 END AS cut FROM faults),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'text': []}}::{_STATE} AS p0,
         NULL::{_STATE} AS p1, NULL::{_STATE} AS p2, NULL::{_STATE} AS p3 FROM turns
  UNION ALL
  SELECT conv_id, i, {', '.join(_best(s) for s in range(4))}
  FROM (SELECT s.conv_id, t.i, p0, p1, p2, p3, role, text, initial, bad, cut
        FROM steps s JOIN turns t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = s.i + 1)),
sums AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE repeated) AS duplicate,
         count(*) FILTER (WHERE short) AS truncated, count(*) FILTER (WHERE odd) AS illegal
  FROM turns GROUP BY conv_id),
ends AS (
  SELECT s.*, list_sort(list_filter([p0, p3], lambda w: w IS NOT NULL))[1] AS best
  FROM sums s JOIN steps t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = s.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.text, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""
