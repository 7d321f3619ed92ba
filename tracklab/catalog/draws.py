"""SQL text of the resampling draws, so that both engines draw the same replicates."""

import math

from tracklab.operators.resampling import PRIME
from tracklab.params import MIN_BLOCKS

#: Thresholds per rate; enough for rates up to about six.
CUTS = 24


def _mixed(x: str, key: str) -> str:
    return f"(({x} * {x} % {PRIME}) * ({x} * {x} % {PRIME}) % {PRIME} * {x} % {PRIME} + {key}) % {PRIME}"


def replicates_sql(src: str, keys: str, identity: str, values: dict[str, str], replicates: int = 2000, seed: int = 42, rate: str = "1.0e0") -> str:
    """(keys, rep, w, s_<name>...) over the rows of ``src``; ``rate`` is a constant of the key."""
    digest = f"md5(concat_ws('|', '{seed}', {identity}))"
    own = ", ".join(f"CAST({e} AS DOUBLE) AS _v_{n}" for n, e in values.items())
    terms = [f"pow(lam, {j}) / {math.factorial(j)}.0e0" for j in range(CUTS)]
    chances = ", ".join(f"exp(-lam) * ({' + '.join(terms[: k + 1])}) AS t{k}" for k in range(CUTS))
    weight = " + ".join(f"CAST(u > t{k} AS INT)" for k in range(CUTS))
    sums = ", ".join(f"sum(w * _v_{n}) AS s_{n}" for n in values)
    return f"""SELECT {keys}, rep, sum(w) AS w, {sums} FROM (
      SELECT {keys}, rep, {', '.join(f'_v_{n}' for n in values)}, {weight} AS w FROM (
        SELECT *, x2 / {PRIME}.0e0 AS u FROM (SELECT *, {_mixed('x1', '_b')} AS x2 FROM (SELECT *, {_mixed('x0', '_a')} AS x1 FROM (
          SELECT {keys}, rep, _a, _b, {', '.join(f'_v_{n}' for n in values)}, (_a + rep * _b) % {PRIME} AS x0 FROM (
            SELECT {keys}, {own}, CAST('0x' || {digest}[1:8] AS BIGINT) % {PRIME} AS _a, 1 + CAST('0x' || {digest}[9:16] AS BIGINT) % ({PRIME} - 1) AS _b FROM {src}
          ), (SELECT unnest(range(1, {replicates} + 1)) AS rep)))))
      JOIN (SELECT {keys}, {chances} FROM (SELECT {keys}, any_value({rate}) AS lam FROM {src} GROUP BY {keys})) USING ({keys}))
    GROUP BY {keys}, rep HAVING sum(w) > 0"""


def interval_sql(reps: str, keys: str, stat: str) -> str:
    return f"SELECT {keys}, quantile_cont({stat}, 0.025) AS ci_low, quantile_cont({stat}, 0.975) AS ci_high FROM ({reps}) GROUP BY {keys}"


def block_ci_sql(src: str, keys: str, values: dict[str, str], stat: str, replicates: int = 2000, seed: int = 42) -> str:
    """(keys, ci_low, ci_high) over moving blocks of ``src``, which has run, pos, i and L; none below the fewest blocks."""
    sums = ", ".join(f"sum({e}) OVER w AS p_{n}" for n, e in values.items())
    blocks = ", ".join(f"p_{n} - CASE WHEN e > L THEN lag(p_{n}, L) OVER w ELSE 0 END AS b_{n}" for n in values)
    made = f"""(SELECT *, ceil(_n / L) / count(*) OVER (PARTITION BY {keys}) AS rate, count(*) OVER (PARTITION BY {keys}) AS n_blocks FROM (
        SELECT {keys}, run, i, L, e, _n, {blocks} FROM (SELECT {keys}, run, pos, i, CAST(L AS INT) AS L, {sums}, row_number() OVER w AS e, count(*) OVER (PARTITION BY {keys}) AS _n
          FROM {src} WINDOW w AS (PARTITION BY {keys}, run ORDER BY pos, i)) WINDOW w AS (PARTITION BY {keys}, run ORDER BY e)) WHERE e >= L)"""
    kept = f"(SELECT * FROM {made} WHERE n_blocks >= {MIN_BLOCKS})"
    reps = replicates_sql(kept, keys, "run, i", {n: f"b_{n}" for n in values} | {"_l": "L"}, replicates, seed, "rate")
    return interval_sql(reps, keys, stat)
