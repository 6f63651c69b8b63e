"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import WORD
from .mixing import BITS, LEVELS
from .queries import RULES, SHARDS, WEIGHTS
from .sharding import SLOTS, fill

_SPACE = 16**9
assert 1 << BITS * LEVELS == _SPACE

#: Thresholds by sorted running sums instead of histograms.
OP8 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS BIGINT) AS most,
    CAST([{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS INTEGER) AS weight
  FROM sized GROUP BY source),
r AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(most) OVER b, 0) AS rest,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS w_left
  FROM s WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_max(rest / w_left, w_left) AS common FROM r WHERE rest / w_left * weight <= most),
t AS (SELECT source, source_size, coalesce(least(most, (SELECT common FROM c) * weight), most) AS target FROM s),
n AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
g AS (
  SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS leaf
  FROM sized GROUP BY source, h),
x AS (
  SELECT n.source, n.target, n.source_size, n.copies, arg_min({{'h': h, 'upto': upto, 'leaf': leaf}}, h) AS b
  FROM n LEFT JOIN g ON n.source IS NOT DISTINCT FROM g.source AND g.upto > n.target - n.copies * n.source_size
  GROUP BY ALL),
y AS (
  SELECT source, target, source_size, copies,
    CASE WHEN b IS NULL THEN 0 WHEN b.upto - (target - copies * source_size) < (target - copies * source_size) - (b.upto - b.leaf)
      THEN b.h + 1 ELSE b.h END AS below
  FROM x)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (copies + CASE WHEN h < below THEN 1 ELSE 0 END) * size END AS BIGINT) AS taken
FROM sized JOIN y ON sized.source IS NOT DISTINCT FROM y.source
"""


def _longest(value) -> str:
    best = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fit = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    return "CASE " + " ".join(f"WHEN {fit(r)} THEN '{value(r)}'" for r in best) + " ELSE NULL END"


def _spread(name: str, seed: str, source: str, target: str, rounds: int = 60, damping: float = 0.85) -> str:
    steps = [
        f"{name}_step AS (SELECT {source} AS host, {target} AS dest, n / sum(n) OVER (PARTITION BY {source}) AS share FROM edges)",
        f"{name}_0 AS (SELECT host, {seed} AS score, {seed} AS seed FROM hosts)",
    ]
    for i in range(rounds):
        steps.append(
            f"{name}_{i + 1} AS MATERIALIZED (SELECT s.host, {damping} * coalesce(g.got, 0) + {1 - damping:.17g} * s.seed AS score, s.seed "
            f"FROM {name}_{i} s LEFT JOIN (SELECT dest, sum(score * share) AS got FROM {name}_{i} JOIN {name}_step USING (host) GROUP BY dest) g ON g.dest = s.host)"
        )
    last = "(CASE WHEN (SELECT count(*) FROM edges) = 0 THEN seed ELSE score END)"
    steps.append(f"{name} AS (SELECT host, CASE WHEN sum({last}) OVER () > 0 THEN {last} / sum({last}) OVER () ELSE 0 END AS score FROM {name}_{rounds})")
    return ",\n".join(steps)


OP9 = f"""
WITH parsed AS (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (SELECT page_id, host, path, {_longest(lambda r: r.text)} AS rule, {_longest(lambda r: r.verdict)} AS said FROM parsed),
hosts AS (
  SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS allowed, avg(CASE WHEN said = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS blocked
  FROM ruled WHERE host <> '' GROUP BY host),
found AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*[\\x22\\x27]?[a-z][a-z0-9+.-]*://([^/?#\\x22\\x27\\s>]*)', 1)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM parsed),
edges AS (
  SELECT src, dst, count(*) AS n FROM found WHERE src <> dst AND src IN (SELECT host FROM hosts) AND dst IN (SELECT host FROM hosts) GROUP BY src, dst),
{_spread("trust", "allowed", "src", "dst")},
{_spread("distrust", "blocked", "dst", "src")},
bad AS (
  SELECT host FROM trust JOIN distrust USING (host)
  WHERE distrust.score > trust.score AND distrust.score * (SELECT count(*) FROM hosts) > 1)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""

def _owners(shards: list[str]) -> str:
    """The filled table as text: three digits for each slot. SQL checks the placement by it; how it is filled is tested in Python."""
    return "".join(f"{k:03d}" for k in fill(shards).tolist())


_SHARD = "'shard-' || substr('{}', 3 * slot + 1, 3)"
OP10 = f"""
WITH placed AS (
  SELECT doc_id, CAST(CASE WHEN doc_id IS NULL THEN 0 ELSE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {SLOTS} END AS INTEGER) AS slot
  FROM documents)
SELECT doc_id, slot, {_SHARD.format(_owners(SHARDS))} AS shard, {_SHARD.format(_owners(SHARDS[:-1]))} AS shard_without_last FROM placed
"""

ORACLES = {"op10_sharding": OP10, "op8_mixing": OP8, "op9_url_filters": OP9}
