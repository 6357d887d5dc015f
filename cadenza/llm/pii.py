"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (digit counts, value
ranges, Luhn, mod-97), and context words nearby raise a span's score.  Positions
come from the lengths of the gaps between matches, so one pass of the expression
engine over a text yields code-point offsets.

The patterns are the base ones made safe for long runs: possessive where giving
back characters can't lead to another match, and barred from starting inside a
run in which an earlier start has failed.  They match the same spans.

Edge cases: null and empty texts have no spans; every row is judged alone, so
repeated rows give repeated results; an empty table gives no rows; columns other
than those named are passed through by ``redact`` and ignored by ``detect``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "array<struct<start:int,end:int,text:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn sum."""
    figures = F.split(F.reverse(digits), "")

    def add(total: Column, i: Column) -> Column:
        v = F.get(figures, i).cast("int") * (F.lit(1) + i % 2)
        return total + v - F.when(v > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (ISO 13616, without spaces) has remainder 1."""
    turned = F.split(F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4)), "")

    def add(rest: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(turned, F.lit(0), add) == 1


def _card(x: Column) -> Column:
    n = F.length(_digits(x))
    return F.when(n.between(13, 19), luhn(_digits(x))).otherwise(False)


def _iban(x: Column) -> Column:
    plain = F.regexp_replace(x, " ", "")
    return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)


#: kind: pattern, what a text must hold to be searched, validator, context words, score without and with context.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", lambda x: F.lit(True), "e-?mail|contact|write|reach", 0.8, 0.95),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", lambda x: x.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"), "ip|host|server|address|login", 0.6, 0.9),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", _card, "card|visa|credit|debit|payment", 0.7, 0.95),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda x: F.length(_digits(x)).between(9, 15), "phone|call|tel|mobile|fax", 0.7, 0.9),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", _iban, "iban|account|bank|transfer", 0.8, 0.95),
}
BASE = ("email", "ip", "card", "phone")
#: Code points on either side of a span in which context words count.
CONTEXT = 40


def _found(text: Column, pattern: str, gate: str, valid) -> Column:
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, x: F.struct(F.length(gap).alias("gap"), x.alias("x")))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.coalesce(F.length(pair["x"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), pair["x"].alias("text")))
        right = F.coalesce(F.when(pair["x"].isNotNull(), valid(pair["x"])), F.lit(False))
        return F.struct(end.alias("at"), F.when(right, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(text.rlike(gate), F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(SPAN))


def _free(start: str, columns: list[str]) -> str:
    """A beginning that no column has."""
    while any(c.lower().startswith(start) for c in columns):
        start += "_"
    return start


def detect(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Adds the array ``out`` of (kind, start, end, score), by kind as listed, then start; ends are exclusive."""
    own = _free("_pii", df.columns)  # what the columns in use here begin with
    whole = f"{own}text"
    df = df.withColumn(whole, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumns({own + kind: _found(F.col(whole), pattern, gate, valid) for kind, (pattern, gate, valid, *_) in KINDS.items()})

    def scored(kind: str) -> Column:
        words, plain, near = KINDS[kind][3:]

        def one(x: Column) -> Column:
            lead = F.least(x["start"], F.lit(CONTEXT))
            around = F.concat(F.substr(whole, x["start"] - lead + 1, lead), F.lit(" "), F.substr(whole, x["end"] + 1, F.lit(CONTEXT)))
            score = F.when(F.lower(around).rlike(rf"(?<![a-z])(?:{words})"), near).otherwise(plain)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

        return F.transform(F.col(own + kind), one)

    df = df.withColumn(out, F.concat(*(scored(kind) for kind in KINDS)))
    return df.drop(whole, *(own + kind for kind in KINDS))


def redact(df: DataFrame, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """Replaces each span of at least that score by its kind in brackets; overlapping spans go as one, under the first one's kind."""
    columns = df.columns
    spans = _free("_found", columns)
    df = detect(df, text_col, spans)
    text = F.col(text_col)
    chosen = F.array_sort(F.transform(F.filter(spans, lambda s: s["score"] >= min_score), lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        more = F.concat(between, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], more)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(chosen, start, step, lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1)))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text)).select(*columns)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the fingerprint of the base spans, and all spans as text."""
    found = detect(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{kind}": of(kind) for kind in (*BASE, "iban")}
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    found = found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.aggregate("spans", F.lit(0.0), lambda m, s: F.greatest(m, s["score"])).alias("top_score"))
    return found
