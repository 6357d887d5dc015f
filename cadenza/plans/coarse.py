"""Coarse band energies of the low-delay codec."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import pcm
from ..operators import coarse as C
from ..sources.adaptors import pcm_blocks
from .quality import _r
from .registry import PX, query, rounded

_BANDS, _LOSS = 16, 20
_MEANS = "[" + ", ".join(f"{m!r}::DOUBLE" for m in C.MEANS[:_BANDS]) + "]"
_EIGHTHS = "[" + ", ".join(map(str, C.EIGHTHS)) + "]"
_WAYS = {"a": (0.0, C.LEAK_ALONE), "b": (C.KEPT[0], C.LEAK[0])}  # alone, predicted


def _each(of: str) -> str:
    """A list of columns for either way; W is the way, KEPT and LEAK its numbers."""
    return ", ".join(re.sub(r"\bW(?=[a-z0-9.])", way, of).replace("KEPT", f"{kept!r}::DOUBLE").replace("LEAK", f"{leak!r}::DOUBLE") for way, (kept, leak) in _WAYS.items())


def _length(x: str) -> str:
    return f"length(bin({x}))"


def _told(way: str) -> str:
    """Eighths of bits that a way has spent."""
    mantissa = f"({way}rng >> ({_length(way + 'rng')} - 16))"
    return f"(8 * ({way}nb - {_length(way + 'rng')}) - (({mantissa} >> 12) - 8) - ({mantissa} > {_EIGHTHS}[({mantissa} >> 12) - 7])::INT)"


_ALONE = f"(budget >= 4 AND (abad < bbad OR (abad = bbad AND {_told('b')} + (budget * trunc(gone)::BIGINT * {_LOSS}) // 512 > {_told('a')})))"
_START = "CASE WHEN {b} >= 4 THEN 268435456 ELSE 2147483648 END::BIGINT AS arng, CASE WHEN {b} >= 4 THEN 1879048192 ELSE 2147483648 END::BIGINT AS brng, 33::BIGINT AS anb, 33::BIGINT AS bnb"
_STATE = "stream_id, block, k, x, budget, i, old, gone, " + _each("Wrng, Wnb, Wprev, Wbad, Wn, Wq")

_SQL = f"""WITH RECURSIVE {PX}, en AS (SELECT stream_id, block, i // 4 AS band, round(log2(sqrt(1e-27 + sum(x * x))) + 8 - ({_MEANS})[(i // 4) + 1], 6) AS e FROM px GROUP BY stream_id, block, i // 4),
fr AS (SELECT stream_id, block, list(e ORDER BY band) AS x, (block % 25) * 8 AS budget, row_number() OVER (PARTITION BY stream_id ORDER BY block) AS k FROM en GROUP BY stream_id, block),
sh(way, band, z, d) AS (SELECT 'a', b, (30 + 4 * b) << 7, (170 - 6 * b) << 6 FROM (SELECT unnest(range({_BANDS})) AS b) UNION ALL SELECT 'b', b, (60 + 5 * b) << 7, (110 - 4 * b) << 6 FROM (SELECT unnest(range({_BANDS})) AS b)),
lp AS (SELECT way, band, z, d, 1 AS m, z AS st, ((32768 - 32 - z) * (16384 - d)) >> 15 AS f FROM sh UNION ALL SELECT way, band, z, d, m + 1, st + 2 * (f + 1), (2 * f * d) >> 15 FROM lp WHERE st + 2 * (f + 1) < 32768),
lt AS (SELECT way, band, any_value(z) AS z, list(st ORDER BY m) AS st, list(f + 1 ORDER BY m) AS sz, -max(m) AS lo, max(CASE WHEN st + f + 1 < 32768 THEN m END) AS hi FROM lp GROUP BY way, band),
tb AS (SELECT a.band, {_each('W.z AS Wz, W.st AS Wst, W.sz AS Wsz, W.lo AS Wlo, W.hi AS Whi')} FROM lt a JOIN lt b ON a.way = 'a' AND b.way = 'b' AND a.band = b.band),
s AS (SELECT stream_id, block, k, x, budget, 0 AS i, list_transform(range({_BANDS}), lambda v: 0.0::DOUBLE) AS old, 0.0::DOUBLE AS gone, arng, anb, 0.0::DOUBLE AS aprev, 0::BIGINT AS abad, []::DOUBLE[] AS an, []::BIGINT[] AS aq, brng, bnb, 0.0::DOUBLE AS bprev, 0::BIGINT AS bbad, []::DOUBLE[] AS bn, []::BIGINT[] AS bq FROM (SELECT *, {_START.format(b='budget')} FROM fr WHERE k = 1)
UNION ALL SELECT stream_id, block, k, x, budget, i + 1, old, gone, {_each('(W1rng << W1sh)::BIGINT, W1nb + W1sh, Wprev + W1q - LEAK * W1q, Wbad + abs(W1w - W1q), list_append(Wn, KEPT * W1o + Wprev + W1q), list_append(Wq, W1q)')}
FROM (SELECT *, {_each('8 * ((W1rng <= 8388608)::BIGINT + (W1rng <= 32768)::BIGINT + (W1rng <= 128)::BIGINT) AS W1sh')}
FROM (SELECT *, {_each('CASE WHEN W1room < 1 THEN Wrng WHEN W1low > 0 THEN (Wrng >> W1bits) * W1size ELSE Wrng - (Wrng >> W1bits) * ((1::BIGINT << W1bits) - W1low - W1size) END AS W1rng')}
FROM (SELECT *, {_each('CASE WHEN W1room >= 15 THEN CASE WHEN W1q = 0 THEN 0 ELSE Wst[abs(W1q)] + CASE WHEN W1q > 0 THEN Wsz[W1q] ELSE 0 END END WHEN W1room >= 2 THEN CASE W1q WHEN 0 THEN 0 WHEN -1 THEN 2 ELSE 3 END ELSE (W1q < 0)::BIGINT END AS W1low, CASE WHEN W1room >= 15 THEN CASE WHEN W1q = 0 THEN Wz ELSE Wsz[abs(W1q)] END WHEN W1room >= 2 AND W1q = 0 THEN 2 ELSE 1 END::BIGINT AS W1size, CASE WHEN W1room >= 15 THEN 15 WHEN W1room >= 2 THEN 2 ELSE 1 END AS W1bits')}
FROM (SELECT *, {_each('(CASE WHEN W1room >= 15 THEN greatest(least(W1c, Whi), Wlo) WHEN W1room >= 2 THEN greatest(least(W1c, 1), -1) WHEN W1room >= 1 THEN least(W1c, 0) ELSE -1 END)::BIGINT AS W1q')}
FROM (SELECT *, {_each(f'CASE WHEN i > 0 AND W1room - 3 * ({_BANDS} - i) < 16 THEN greatest(least(W1w, 1), -1) WHEN i > 0 AND W1room - 3 * ({_BANDS} - i) < 24 THEN least(W1w, 1) ELSE W1w END AS W1c')}
FROM (SELECT *, {_each('(CASE WHEN floor(0.5 + W1f) < 0 AND e < floor_ THEN least(floor(0.5 + W1f) + trunc(floor_ - e), 0) ELSE floor(0.5 + W1f) END)::BIGINT AS W1w')}
FROM (SELECT *, {_each('e - KEPT * W1o - Wprev AS W1f')} FROM (SELECT *, x[i + 1] AS e, greatest(old[i + 1], -28.0::DOUBLE) - least(16.0::DOUBLE, budget / 64.0::DOUBLE) AS floor_, {_each(f'greatest(old[i + 1], -9.0::DOUBLE) AS W1o, budget - (Wnb - {_length("Wrng")}) AS W1room, Wnb AS W1nb')}
FROM (SELECT stream_id, block, k, x, budget, i, old, gone, arng, anb, aprev, abad, an, aq, brng, bnb, bprev, bbad, bn, bq FROM s WHERE i < {_BANDS}
UNION ALL SELECT stream_id, f.block, f.k, f.x, f.budget, 0, won, CASE WHEN alone THEN moved ELSE {C.KEPT[0] ** 2!r}::DOUBLE * gone + moved END, f.arng, f.anb, 0.0::DOUBLE, 0, []::DOUBLE[], []::BIGINT[], f.brng, f.bnb, 0.0::DOUBLE, 0, []::DOUBLE[], []::BIGINT[]
FROM (SELECT *, {_ALONE} AS alone, CASE WHEN {_ALONE} THEN an ELSE bn END AS won, least(200.0::DOUBLE, list_sum(list_transform(list_zip(x, old), lambda v: (v[1] - v[2]) * (v[1] - v[2])))) AS moved FROM s WHERE i = {_BANDS}) l JOIN (SELECT stream_id, block, k, x, budget, {_START.format(b='budget')} FROM fr) f USING (stream_id) WHERE f.k = l.k + 1) JOIN tb ON tb.band = i)))))))))
SELECT stream_id, block, unnest(range({_BANDS})) AS band, alone, eighths::BIGINT AS eighths, unnest(q) AS step, {rounded('unnest(won)')} AS energy FROM (SELECT *, {_ALONE} AS alone, CASE WHEN {_ALONE} THEN {_told('a')} ELSE {_told('b')} END AS eighths, CASE WHEN {_ALONE} THEN aq ELSE bq END AS q, CASE WHEN {_ALONE} THEN an ELSE bn END AS won FROM s WHERE i = {_BANDS})"""


@query(_SQL)
def coarse_energies(spark, sf_dir):
    """Whole steps and decoded energies of 16 bands for each block of each stream in 0 to 24 bytes, predicted or alone."""
    mode = C.Energies(C.ruled_shapes(_BANDS), loss=_LOSS)
    level = lambda k: _r(F.log2(F.sqrt(1e-27 + pcm.total(F.slice("samples", 4 * k + 1, 4), lambda v: v * v))) + 8 - C.MEANS[k])
    blocks = pcm_blocks(spark, sf_dir).select("stream_id", "block", F.array(*(level(k) for k in range(_BANDS))).alias("x"), (F.col("block") % 25).alias("size"))
    coded = C.coarse(blocks, "stream_id", "block", "x", "size", mode)
    long = coded.select("stream_id", "block", "alone", "eighths", F.posexplode(F.arrays_zip("steps", "energies")).alias("band", "z"))
    return long.select("stream_id", "block", F.col("band").cast("long").alias("band"), "alone", "eighths", F.col("z.steps").alias("step"), _r("z.energies").alias("energy"))
