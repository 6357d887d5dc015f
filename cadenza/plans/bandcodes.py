"""Standard codebooks of bands at their real borders, and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import transforms as T
from ..operators import bandcodes as B
from ..operators import spectra as S
from ..sources.adaptors import pcm_blocks
from .registry import PX, query

_LINES = B.SHORT[-1]
_BITLEN = "(CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END)"
_BOOKS = ", ".join(f"({b}, {w}, {m}, {int(s)}, {2 if b % 2 and b != B.ESCAPE_BOOK else 1})" for b, (w, m, s) in B.SHAPES.items())
_BORDERS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(B.SHORT, B.SHORT[1:], strict=False)))
#: Four blocks are a frame of 256 samples; the step doubles from frame to frame over eight sizes.
_STEP = "0.05::DOUBLE * (1 << (frame % 8))"

#: A band's bits under a book: a base for each tuple, a slope for each bit of each magnitude, signs and escapes.
_SQL = f"""WITH {PX}, fa AS (SELECT block // 4 AS frame, (block % 4) * 64 + i AS n, x FROM px), fu AS (SELECT frame FROM fa GROUP BY frame HAVING count(*) = 256),
li AS (SELECT frame, line, sum(x * sin(pi() / 256 * (n + 0.5)) * cos(pi() / {_LINES} * (n + 0.5 + {_LINES // 2}) * (line + 0.5))) AS c FROM fa JOIN fu USING (frame) CROSS JOIN (SELECT unnest(range({_LINES})) AS line) GROUP BY frame, line),
qu AS (SELECT frame, line, round(pow(abs(c), 0.75) / ({_STEP}))::BIGINT AS m FROM li), bo(band, lo, hi) AS (VALUES {_BORDERS}), bk(book, width, most, signed, slope) AS (VALUES {_BOOKS}),
ba AS (SELECT book, width, most, signed, slope, ceil(width * log2(sum((CASE WHEN signed = 1 AND v > 0 THEN 2 ELSE 1 END) * pow(2::DOUBLE, -slope * {_BITLEN.format('v')}))))::BIGINT AS base FROM bk JOIN (SELECT unnest(range(17)) AS v) ON v <= most GROUP BY book, width, most, signed, slope),
bm AS (SELECT frame, band, any_value(hi - lo) AS size, max(m) AS top, sum({_BITLEN.format('least(m, 16)')}) AS mags, sum((m > 0)::INT) AS signs, sum(CASE WHEN m >= 16 THEN 2 * (length(bin(m)) - 1) - 3 ELSE 0 END) AS esc FROM qu JOIN bo ON line >= lo AND line < hi GROUP BY frame, band),
co AS (SELECT frame, band, book, size // width * base + slope * mags + (1 - signed) * signs + CASE WHEN book = 11 THEN esc ELSE 0 END AS cost FROM bm JOIN ba ON size % width = 0 AND top <= CASE WHEN book = 11 THEN {B.MOST} ELSE most END WHERE top > 0),
be AS (SELECT frame, band, arg_min(book, (cost, book))::BIGINT AS codebook, min(cost)::BIGINT AS bits FROM co GROUP BY frame, band UNION ALL SELECT frame, band, 0, 0 FROM bm WHERE top = 0 UNION ALL SELECT frame, band, -1, -1 FROM bm WHERE top > {B.MOST})"""


def _coded(spark, sf_dir):
    """codebooks and bits of the fourteen bands of each whole frame."""
    blocks = pcm_blocks(spark, sf_dir).select(F.floor(F.col("block") / 4).alias("frame"), (F.col("block") % 4).alias("place"), "samples")
    held = blocks.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("place", "samples"))).alias("h")).where(F.size("h") == 4)
    lines = S.transform(held.select("frame", F.flatten("h.samples").alias("samples")), "samples", S.mdct_matrix(_LINES, T.sine_window(2 * _LINES)), "lines")
    step = 0.05 * F.pow(F.lit(2.0), F.col("frame") % 8)
    q = lines.select("frame", F.transform("lines", lambda c: C.power_quantise(c, step)).alias("q"))
    return B.band_books(q, "q", B.SHORT, B.ruled_books())


@query(f"{_SQL} SELECT frame, band::BIGINT AS band, codebook, bits FROM be")
def standard_codebooks(spark, sf_dir):
    """The cheapest of the eleven standard books for each band of short blocks: signed and unsigned quads and pairs, and escapes."""
    long = _coded(spark, sf_dir).select("frame", F.posexplode(F.arrays_zip("codebooks", "bits")).alias("band", "z"))
    return long.select("frame", F.col("band").cast("long").alias("band"), F.col("z.codebooks").alias("codebook"), F.col("z.bits").alias("bits"))


@query(f"""{_SQL}, ok AS (SELECT frame FROM be GROUP BY frame HAVING min(codebook) >= 0), g AS (SELECT be.*, band - row_number() OVER (PARTITION BY frame, codebook ORDER BY band) AS island FROM be JOIN ok USING (frame)),
s AS (SELECT frame, codebook, min(band) AS a, max(band) AS b, sum(bits)::BIGINT AS bits FROM g GROUP BY frame, codebook, island)
SELECT frame, (row_number() OVER (PARTITION BY frame ORDER BY a) - 1)::BIGINT AS section, codebook, x.lo::BIGINT AS line_start, y.hi::BIGINT AS line_end, bits, (4 + 3 * ((b - a + 1) // 7 + 1))::BIGINT AS header_bits FROM s JOIN bo x ON x.band = a JOIN bo y ON y.band = b""")
def standard_sections(spark, sf_dir):
    """Neighbouring bands of one standard book as sections, with the bits of their headers."""
    found = _coded(spark, sf_dir).select("frame", F.posexplode(B.sections(F.col("codebooks"), F.col("bits"), B.SHORT, field=3)).alias("section", "s"))
    return found.select("frame", F.col("section").cast("long").alias("section"), "s.codebook", "s.line_start", "s.line_end", "s.bits", "s.header_bits")
