"""Code tables of regions by cost, borders of regions, and steps within a budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import filterbank as H
from ..operators import regions as R
from .filterbank import LONG, granules
from .registry import query

STEP = 0.04
STEPS = tuple(0.005 * 2 ** (k / 2) for k in range(14))
TABLES = R.ruled_tables()
EDGES = (*H.LONG_BANDS, H.GRANULE)
#: Borders of the regions of address 0, 0: the first two bands.
FIRST = (0, *H.LONG_BANDS[1:3], H.GRANULE)

_BITLEN = "(CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END)"
_PLAIN = ", ".join(f"({k}, {t.table}, {t.most}, {sum(t.most == u.most and not u.suffixed for u in TABLES[:k]) if not t.suffixed else (0 if t.table == 16 else 2)}, {int(t.suffixed)})" for k, t in enumerate(TABLES))
_SUFFIX = ", ".join(f"({family}, {k}, {bits})" for family, row in R.SUFFIX.items() for k, bits in enumerate(row))
_QUADS = ", ".join(f"({t}, {k}, {bits})" for t, row in enumerate(R.QUADS) for k, bits in enumerate(row))


def _spectrum(step: str, steps: str = "") -> str:
    """Quantised lines of each unit (granule, and step where there is a ladder), where they end, and its pairs."""
    unit = "clip, g, step"
    return f"""{LONG}, st AS (SELECT unnest([{step}]::DOUBLE[]) AS step){steps}, qa AS (SELECT {unit}, line, round(pow(abs(v), 0.75) / step)::BIGINT AS m FROM ln CROSS JOIN st),
ok AS (SELECT {unit} FROM qa GROUP BY {unit} HAVING max(m) <= {R.MOST}), qs AS (SELECT qa.* FROM qa JOIN ok USING ({unit})),
la AS (SELECT {unit}, coalesce(max(CASE WHEN m <> 0 THEN line + 1 END), 0) AS last, coalesce(max(CASE WHEN m > 1 THEN line + 1 END), 0) AS large FROM qs GROUP BY {unit}),
rg AS (SELECT {unit}, (last - large) // 4 AS quads, (last - 4 * ((last - large) // 4) + 1) // 2 AS big FROM la),
pr AS (SELECT {unit}, line // 2 AS p, sum(CASE WHEN line % 2 = 0 THEN m ELSE 0 END)::BIGINT AS x, sum(CASE WHEN line % 2 = 1 THEN m ELSE 0 END)::BIGINT AS y, big FROM qs JOIN rg USING ({unit}) WHERE line // 2 < big GROUP BY {unit}, p, big),
tb(ord, tab, most, v, suffixed) AS (VALUES {_PLAIN}), sx(tab, k, bits) AS (VALUES {_SUFFIX}), qt(tab, name, bits) AS (VALUES {_QUADS}),
qd AS (SELECT {unit}, tab, sum(bits + ones)::BIGINT AS bits FROM (SELECT {unit}, (line - 2 * big) // 4 AS quad, sum(m * (8 >> ((line - 2 * big) % 4)::INTEGER))::BIGINT AS name, sum(m)::BIGINT AS ones FROM qs JOIN rg USING ({unit}) WHERE line >= 2 * big AND line < 2 * big + 4 * quads GROUP BY {unit}, quad) JOIN qt USING (name) GROUP BY {unit}, tab)"""


def _costs(keys: str, pairs: str) -> str:
    """The cheapest table of each of the keys, of pairs with x and y."""
    return f"""tm AS (SELECT {keys}, max(greatest(x, y)) AS top FROM {pairs} GROUP BY {keys}),
cd AS (SELECT {keys}, tm.top, ord, tb.tab, most, v, suffixed, sx.k, coalesce(sx.bits, 0) AS linbits, row_number() OVER (PARTITION BY {keys}, ord ORDER BY sx.k) AS first FROM tm JOIN tb ON suffixed = 1 OR top <= most LEFT JOIN sx ON suffixed = 1 AND sx.tab = tb.tab AND sx.bits >= {_BITLEN.format('greatest(top - 15, 0)')} WHERE top > 0),
pc AS (SELECT {keys}, ord, any_value(tab + coalesce(k, 0)) AS tab, any_value(linbits) AS linbits, sum(1 + v + (4 - v) * ({_BITLEN.format('least(x, most)')} + {_BITLEN.format('least(y, most)')}) // 2 + {_BITLEN.format('most')} + (x > 0)::INT + (y > 0)::INT + linbits * ((x >= 15)::INT + (y >= 15)::INT))::BIGINT AS bits FROM {pairs} JOIN cd USING ({keys}) WHERE first = 1 GROUP BY {keys}, ord),
be AS (SELECT {keys}, min({{'bits': bits, 'ord': ord, 'tab': tab, 'linbits': linbits}}) AS b FROM pc GROUP BY {keys})"""






@query(f"""WITH {_spectrum(str(STEP))}, rp AS (SELECT *, CASE WHEN 2 * p < {FIRST[1]} THEN 0 WHEN 2 * p < {FIRST[2]} THEN 1 ELSE 2 END AS region FROM pr), {_costs('clip, g, step, region', 'rp')}
SELECT rg.clip, rg.g::BIGINT AS granule, r.region::BIGINT AS region, coalesce(b.tab, 0)::BIGINT AS table_select, coalesce(b.linbits, 0)::BIGINT AS linbits, coalesce(b.bits, 0)::BIGINT AS bits, big::BIGINT AS big_pairs FROM rg CROSS JOIN (SELECT unnest(range(3)) AS region) r LEFT JOIN be ON be.clip = rg.clip AND be.g = rg.g AND be.region = r.region""")
def region_tables(spark, sf_dir):
    """The cheapest code table of each of a granule's three regions, with its suffix bits and cost."""

    def run(lines):
        c = R.costs(R.quantised(lines, STEP), FIRST, TABLES)
        found = [R.cheapest_table(c, TABLES, k, k + 1) for k in range(3)]
        return {"table_select": np.stack([f[0] for f in found], 1), "linbits": np.stack([f[1] for f in found], 1), "bits": np.stack([f[2] for f in found], 1), "big_pairs": c.big_pairs, "fits": c.fits.astype(np.int64)}

    kinds = {"table_select": "array<bigint>", "linbits": "array<bigint>", "bits": "array<bigint>", "big_pairs": "bigint", "fits": "bigint"}
    found = R.by_rows(granules(spark, sf_dir), "lines", H.GRANULE, kinds, run).where("fits = 1")
    long = found.select("clip", "granule", "big_pairs", F.posexplode(F.arrays_zip("table_select", "linbits", "bits")).alias("region", "r"))
    return long.select("clip", "granule", F.col("region").cast("long").alias("region"), "r.table_select", "r.linbits", "r.bits", "big_pairs")


@query(f"""WITH {_spectrum(str(STEP))} SELECT rg.clip, rg.g::BIGINT AS granule, quads::BIGINT AS quads, coalesce(a.bits, 0)::BIGINT AS first_bits, coalesce(b.bits, 0)::BIGINT AS second_bits, (CASE WHEN coalesce(b.bits, 0) < coalesce(a.bits, 0) THEN 1 ELSE 0 END)::BIGINT AS table_select
FROM rg LEFT JOIN qd a ON a.clip = rg.clip AND a.g = rg.g AND a.tab = 0 LEFT JOIN qd b ON b.clip = rg.clip AND b.g = rg.g AND b.tab = 1""")
def count1_tables(spark, sf_dir):
    """Costs of both tables of quads and the cheaper one, the first where equal."""

    def run(lines):
        c = R.costs(R.quantised(lines, STEP), FIRST, TABLES)
        return {"quads": c.quads, "first_bits": c.count1[:, 0], "second_bits": c.count1[:, 1], "table_select": c.count1.argmin(1), "fits": c.fits.astype(np.int64)}

    return R.by_rows(granules(spark, sf_dir), "lines", H.GRANULE, dict.fromkeys(("quads", "first_bits", "second_bits", "table_select", "fits"), "bigint"), run).where("fits = 1").drop("fits")


_EDGES = ", ".join(f"({k}, {e})" for k, e in enumerate(EDGES))


@query(f"""WITH {_spectrum(str(STEP))}, ed(k, e) AS (VALUES {_EDGES}), iv AS (SELECT a.k AS i, b.k AS j, a.e // 2 AS lo, b.e // 2 AS hi FROM ed a JOIN ed b ON b.k > a.k),
rp AS (SELECT pr.*, i, j FROM pr JOIN iv ON p >= lo AND p < hi), {_costs('clip, g, step, i, j', 'rp')},
aw AS (SELECT rg.clip, rg.g, iv.i, iv.j, coalesce(b.bits, 0) AS bits FROM rg CROSS JOIN iv LEFT JOIN be ON be.clip = rg.clip AND be.g = rg.g AND be.i = iv.i AND be.j = iv.j),
ch AS (SELECT a.clip, a.g, min({{'bits': a.bits + b.bits + coalesce(c.bits, 0), 'r0': a.j - 1, 'r1': b.j - b.i - 1}}) AS m FROM aw a JOIN aw b ON b.clip = a.clip AND b.g = a.g AND b.i = a.j LEFT JOIN aw c ON c.clip = b.clip AND c.g = b.g AND c.i = b.j AND c.j = {len(EDGES) - 1} WHERE a.i = 0 AND a.j <= 16 AND b.j - b.i <= 8 AND (c.bits IS NOT NULL OR b.j = {len(EDGES) - 1}) GROUP BY a.clip, a.g)
SELECT clip, g::BIGINT AS granule, m.r0::BIGINT AS region0_count, m.r1::BIGINT AS region1_count, m.bits::BIGINT AS bits FROM ch""")
def region_borders(spark, sf_dir):
    """The borders, among all that a header can state, whose three regions cost least."""

    def run(lines):
        c = R.costs(R.quantised(lines, STEP), EDGES, TABLES)
        first, second, bits = R.cheapest_borders(c, TABLES)
        return {"region0_count": first, "region1_count": second, "bits": bits, "fits": c.fits.astype(np.int64)}

    return R.by_rows(granules(spark, sf_dir), "lines", H.GRANULE, dict.fromkeys(("region0_count", "region1_count", "bits", "fits"), "bigint"), run).where("fits = 1").drop("fits")


@query(f"""WITH {_spectrum(', '.join(repr(s) for s in STEPS))}, rp AS (SELECT *, CASE WHEN 2 * p < {FIRST[1]} THEN 0 WHEN 2 * p < {FIRST[2]} THEN 1 ELSE 2 END AS region FROM pr), {_costs('clip, g, step, region', 'rp')},
tt AS (SELECT rg.clip, rg.g, rg.step, coalesce(p.bits, 0) + coalesce(c.bits, 0) AS bits, 400 + 150 * (rg.clip % 5) + 100 * rg.g AS budget FROM rg LEFT JOIN (SELECT clip, g, step, sum(b.bits) AS bits FROM be GROUP BY ALL) p ON p.clip = rg.clip AND p.g = rg.g AND p.step = rg.step LEFT JOIN (SELECT clip, g, step, min(bits) AS bits FROM qd GROUP BY ALL) c ON c.clip = rg.clip AND c.g = rg.g AND c.step = rg.step),
fi AS (SELECT clip, g, min({{'step': step, 'bits': bits}}) AS m FROM tt WHERE bits <= budget GROUP BY clip, g)
SELECT u.clip, u.g::BIGINT AS granule, (400 + 150 * (u.clip % 5) + 100 * u.g)::BIGINT AS budget, m.step AS step, m.bits::BIGINT AS bits, (m.step IS NOT NULL) AS fits FROM (SELECT DISTINCT clip, g FROM ln) u LEFT JOIN fi ON fi.clip = u.clip AND fi.g = u.g""")
def step_details(spark, sf_dir):
    """The finest step of a ladder whose payload fits each granule's budget of bits; null where none does."""
    asked = granules(spark, sf_dir).withColumn("budget", (400 + 150 * (F.col("clip") % 5) + 100 * F.col("granule")).cast("long"))

    def run(lines, budget):
        step, bits, _ = R.finest_fitting(lines, budget, STEPS, lambda q: R.payload_bits(q, FIRST, TABLES))
        return {"step": step, "bits": bits}

    found = R.by_rows(asked, "lines", H.GRANULE, {"step": "double", "bits": "bigint"}, run, "budget")
    fits = F.col("bits") >= 0
    return found.select("clip", "granule", "budget", F.when(fits, F.col("step")).alias("step"), F.when(fits, F.col("bits")).alias("bits"), fits.alias("fits"))
