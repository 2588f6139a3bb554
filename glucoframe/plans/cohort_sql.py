"""The visit cohort as SQL, for checking results in a second engine."""

from __future__ import annotations

GLUCAGON = {1: 0, 2: 30, 3: 60, 5: 120}
MINUTES = {1: 0, 2: 30, 3: 60, 4: 90, 5: 120}


def _pivot(measure: str, slots) -> str:
    return ", ".join(f"max(CASE WHEN n = {n} THEN {measure} END) AS {measure}{n}" for n in slots)


SLOTS = """
slots AS (
  SELECT o_custkey AS c, CAST(year(o_orderdate) AS BIGINT) AS y, l_linenumber AS n, count(*) AS k,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS q,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS e,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS d,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2, 3
)"""

_GLUCOSE = ", ".join(
    (f"CASE WHEN c % 97 = 0 AND k{n} IS NOT NULL THEN 0E0 ELSE 32E-1 + q{n} / k{n} / 5 END AS g{t}" if n == 1
     else f"32E-1 + q{n} / k{n} / 5 AS g{t}")
    for n, t in MINUTES.items()
)
_INSULIN = ", ".join(f"10E0 + e{n} / k{n} / 20000 AS i{t}" for n, t in MINUTES.items())
_GLUCAGON = ", ".join(f"3E0 + d{n} / k{n} AS gl{t}" for n, t in GLUCAGON.items())

COHORT = f"""{SLOTS},
pivoted AS (
  SELECT c, y, {_pivot('k', range(1, 7))}, {_pivot('q', MINUTES)}, {_pivot('e', MINUTES)},
         {_pivot('d', GLUCAGON)}, max(CASE WHEN n = 6 THEN t END) AS t6
  FROM slots GROUP BY c, y
),
cohort AS (
  SELECT c * 10000 + y AS visit_id, {_GLUCOSE}, {_INSULIN}, {_GLUCAGON},
         2E-1 + t6 / k6 / 10 AS ffa0,
         CASE WHEN c % 20 = 0 THEN NULL WHEN c % 2 = 1 THEN 'male' ELSE 'female' END AS sex,
         CAST((c + y) % 50 + 20 AS DOUBLE) AS age,
         50E0 + (c_acctbal + 1000) / 200 AS weight,
         CAST((c * 7) % 20 + 18 AS DOUBLE) AS bmi,
         CAST((c * 13) % 55 + 60 AS DOUBLE) AS waist,
         5E-1 + CAST((c * 31 + y) % 300 AS DOUBLE) / 100 AS tg,
         CASE WHEN c % 11 = 0 THEN NULL ELSE 8E-1 + CAST((c * 17) % 130 AS DOUBLE) / 100 END AS hdl,
         CAST((c * 5) % 25 + 12 AS DOUBLE) AS fat_mass,
         1E0 + CAST(c % 40 AS DOUBLE) / 10 AS rate_glycerol,
         1E0 + CAST(c % 30 AS DOUBLE) / 10 AS rate_palmitate
  FROM pivoted JOIN customer ON c = c_custkey
)"""

# converted units, one name per sample
_CONVERTED = ", ".join(
    [f"g{t} * 18E0 AS gm{t}" for t in MINUTES.values()] + [f"i{t} / 6E0 AS iu{t}" for t in MINUTES.values()]
)
PREPARED = f"""{COHORT},
prepared AS (SELECT *, {_CONVERTED}, tg * 8857E-2 AS tgmg, hdl * 3867E-2 AS hdlmg FROM cohort)"""


def with_cohort(query: str) -> str:
    return f"WITH {COHORT.strip()}\n{query}"


def with_prepared(query: str, *ctes: str) -> str:
    more = "".join(f",\n{c.strip()}" for c in ctes)
    return f"WITH {PREPARED.strip()}{more}\n{query}"
