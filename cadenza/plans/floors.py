"""Floors fitted to masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import floorfit as K
from ..operators import regions as R
from ..sources.adaptors import pcm_blocks
from .registry import PX, query

SIZE = 64
POSTS = (0, 64, 32, 16, 48, 8, 24, 40, 56, 4, 12, 28)
_ORDER = sorted(range(len(POSTS)), key=lambda k: POSTS[k])
_RANK = [_ORDER.index(p) for p in range(len(POSTS))]


def _line(start: str, end: str) -> str:
    """Struct of both ends and whether there is no line, over divisions start ... end - 1 of a block's lists."""
    n, x, xx, y, xy = (f"list_sum({c}[{start} + 1 : {end}])" for c in ("nl", "xl", "xxl", "yl", "xyl"))
    a, b, d = f"({y} * {xx} - {xy} * {x})", f"({n} * {xy} - {x} * {y})", f"({n} * {xx} - {x} * {x})"
    at = lambda p: f"CASE WHEN {d} > 0 THEN greatest(least(round_even(round({a} / {d} + {b} / {d} * sx[{p} + 1], 6), 0), 1023), 0)::BIGINT ELSE 0 END"
    return f"{{'y0': {at(start)}, 'y1': {at(end)}, 'none': {d} <= 0}}"


def _value(p: str) -> str:
    return f"CASE WHEN va[{p} + 1] < 0 THEN vb[{p} + 1] WHEN vb[{p} + 1] < 0 THEN va[{p} + 1] ELSE (va[{p} + 1] + vb[{p} + 1]) >> 1 END"


def _put(values: str, place: str, value: str) -> str:
    return f"list_transform({values}, lambda e, k: CASE WHEN k = {place} + 1 THEN {value} ELSE e END)"


_Y = "(ly + (x - lx) * (sign(hy - ly)::BIGINT * (abs(hy - ly) // (hx - lx))) + CASE WHEN hy < ly THEN -1 ELSE 1 END * ((x - lx) * (abs(hy - ly) - abs(hy - ly) // (hx - lx) * (hx - lx)) // (hx - lx)))"
_SPLITS = f"""lv AS (SELECT block, i, round(20 * log10(greatest(abs(x), 1e-6)) * 16) / 16 AS f FROM px), mk AS (SELECT block, i, f, sum(f) OVER (PARTITION BY block ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 - 6 AS m FROM lv),
qv AS (SELECT block, i, greatest(least(trunc(m * 7.3142857 + 1023.5), 1023), 0)::BIGINT AS q, f + 18 >= m AS aud FROM mk), cs AS (SELECT {list(POSTS)} AS ps, {_RANK} AS rk, {[POSTS[p] for p in _ORDER]} AS sx),
dv AS (SELECT unnest(range({len(POSTS) - 1})) AS k, unnest(sx[:-2]) AS x0, unnest(sx[2:]) AS x1 FROM cs),
dw AS (SELECT block, k, count(*) FILTER (q <> 0 AND aud) AS an, count(*) FILTER (q <> 0) / (count(*) FILTER (q <> 0 AND aud) + 1.0::DOUBLE) + 1 AS w FROM qv JOIN dv ON i >= x0 AND i <= least(x1, {SIZE - 1}) GROUP BY block, k),
ds AS (SELECT qv.block, dv.k, any_value(dw.an) AS an, sum(CASE WHEN q = 0 THEN 0 WHEN aud THEN w ELSE 1 END) AS n, sum(CASE WHEN q = 0 THEN 0 WHEN aud THEN w ELSE 1 END * i) AS x, sum(CASE WHEN q = 0 THEN 0 WHEN aud THEN w ELSE 1 END * i * i) AS xx, sum(CASE WHEN aud THEN w ELSE 1 END * q) AS y, sum(CASE WHEN aud THEN w ELSE 1 END * q * i) AS xy FROM qv JOIN dv ON i >= x0 AND i <= least(x1, {SIZE - 1}) JOIN dw ON dw.block = qv.block AND dw.k = dv.k GROUP BY qv.block, dv.k),
bl AS (SELECT block, list(n ORDER BY k) AS nl, list(x ORDER BY k) AS xl, list(xx ORDER BY k) AS xxl, list(y ORDER BY k) AS yl, list(xy ORDER BY k) AS xyl, sum(an) AS heard FROM ds GROUP BY block), ql AS (SELECT block, list(q ORDER BY i) AS ql, list(aud ORDER BY i) AS al FROM qv GROUP BY block),
b0 AS (SELECT block, {_line('0', str(len(POSTS) - 1))} AS l FROM bl CROSS JOIN cs),
st AS (SELECT block, 2 AS i, list_transform(range({len(POSTS)}), lambda k: CASE k WHEN 0 THEN l.y0 WHEN 1 THEN l.y1 ELSE -200 END) AS va, list_transform(range({len(POSTS)}), lambda k: CASE k WHEN 0 THEN l.y0 WHEN 1 THEN l.y1 ELSE -200 END) AS vb, list_transform(range({len(POSTS)}), lambda k: 0::BIGINT) AS lo, list_transform(range({len(POSTS)}), lambda k: 1::BIGINT) AS hi, list_transform(range({len(POSTS)}), lambda k: -1::BIGINT) AS seen FROM b0
UNION ALL SELECT block, i + 1, CASE WHEN cut THEN {_put(_put(_put('va', 'CASE WHEN l = 0 THEN 0 ELSE -1 END', 'y00'), 'i', 'y01'), 'h', 'y11')} ELSE va END, CASE WHEN cut THEN {_put(_put(_put('vb', 'l', 'y00'), 'i', 'y10'), 'CASE WHEN h = 1 THEN 1 ELSE -1 END', 'y11')} ELSE vb END,
CASE WHEN used THEN list_transform(lo, lambda e, k: CASE WHEN k > sp + 1 AND e = l THEN i ELSE e END) ELSE lo END, CASE WHEN used THEN list_transform(hi, lambda e, k: CASE WHEN k <= sp AND e = h THEN i ELSE e END) ELSE hi END, {_put('seen', 'l', 'h')}
FROM (SELECT *, cut AND (y01 >= 0 OR y10 >= 0) AS used FROM (SELECT *, fresh AND far AND NOT (f0.none AND f1.none) AS cut, CASE WHEN f0.none THEN ly ELSE f0.y0 END AS y00, CASE WHEN f0.none THEN f1.y0 ELSE f0.y1 END AS y01, CASE WHEN f1.none THEN CASE WHEN f0.none THEN f1.y0 ELSE f0.y1 END ELSE f1.y0 END AS y10, CASE WHEN f1.none THEN hy ELSE f1.y1 END AS y11
FROM (SELECT *, {_line('rk[l + 1]', 'sp')} AS f0, {_line('sp', 'rk[h + 1]')} AS f1, len(list_filter(range(lx, hx), lambda x: al[x + 1] AND (ql[x + 1] <> 0 OR x = lx) AND ({_Y} + 60 < ql[x + 1] OR {_Y} - 30 > ql[x + 1]))) > 0
OR (3600.0 / (hx - lx) <= 500 AND 900.0 / (hx - lx) <= 500 AND list_sum(list_transform(range(lx, hx), lambda x: ({_Y} - ql[x + 1]) * ({_Y} - ql[x + 1])))::BIGINT // (hx - lx) > 500) AS far
FROM (SELECT *, seen[l + 1] <> h AS fresh, ps[l + 1]::BIGINT AS lx, ps[h + 1]::BIGINT AS hx, {_value('l')} AS ly, {_value('h')} AS hy FROM (SELECT st.*, cs.*, bl.nl, bl.xl, bl.xxl, bl.yl, bl.xyl, ql.ql, ql.al, rk[i + 1] AS sp, lo[rk[i + 1] + 1] AS l, hi[rk[i + 1] + 1] AS h FROM st JOIN bl USING (block) JOIN ql USING (block) CROSS JOIN cs WHERE i < {len(POSTS)})))))),
fv AS (SELECT st.block, list_transform(range({len(POSTS)}), lambda p: {_value('p')}) AS v FROM st JOIN bl USING (block) WHERE i = {len(POSTS)} AND heard > 0)"""
_NEAR = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(K.neighbours(POSTS), 2))
#: Posts in order, each predicted from its two neighbours unless its own value is another.
_POSTED = f"""{_SPLITS}, ng(i, a, b) AS (VALUES {_NEAR}), po AS (SELECT block, 2 AS i, v, [v[1], v[2]] AS o FROM fv UNION ALL
SELECT block, i + 1, v, list_append(o, CASE WHEN v[i + 1] >= 0 AND v[i + 1] <> g THEN v[i + 1] ELSE g | 32768 END) FROM (SELECT po.*, ((o[a + 1] & 32767) + CASE WHEN (o[b + 1] & 32767) < (o[a + 1] & 32767) THEN -1 ELSE 1 END * (abs((o[b + 1] & 32767) - (o[a + 1] & 32767)) * (ps[i + 1] - ps[a + 1]) // (ps[b + 1] - ps[a + 1])))::BIGINT AS g FROM po JOIN ng USING (i) CROSS JOIN cs))"""


@query(f"WITH RECURSIVE {PX}, {_POSTED} SELECT block, unnest(range({len(POSTS)}))::BIGINT AS post, unnest(o)::BIGINT AS level FROM po WHERE i = {len(POSTS)}")
def floor_posts(spark, sf_dir):
    """The posts of a floor under each block's mask: lines by least squares, split where they stray; marked where neighbours predict them."""
    decibels = F.transform("samples", lambda x: F.round(20 * F.log10(F.greatest(F.abs(x), F.lit(1e-6))) * 16) / 16)

    def run(lines):
        sums = np.concatenate([np.zeros((len(lines), 1)), np.cumsum(lines, 1)], 1)
        at = np.arange(SIZE)
        mask = (sums[:, np.minimum(at + 4, SIZE)] - sums[:, np.maximum(at - 4, 0)]) / 8 - 6
        posts, held = K.fit(lines, mask, POSTS)
        return {"levels": posts, "held": held.astype(np.int64)}

    found = R.by_rows(pcm_blocks(spark, sf_dir).select("block", decibels.alias("f")), "f", SIZE, {"levels": "array<bigint>", "held": "bigint"}, run)
    long = found.where("held = 1").select("block", F.posexplode("levels").alias("post", "level"))
    return long.select("block", F.col("post").cast("long").alias("post"), "level")
