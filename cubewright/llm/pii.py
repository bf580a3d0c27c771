"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (octets up to 255, Luhn, digit counts, mod 97), and words
nearby adjust the score: a social-security number or a secret (a long run of letters and digits) counts only after such a word. All spans are
code points, end exclusive.

The patterns run in linear time on any text: repeats are possessive, and a run that can't match is not tried again from
each of its characters (``\\G``: or right after the match before). Places are running sums of lengths by doubling steps, contexts are
cut from the ends of what lies between matches, and redacted texts are cut from blocks of ``BLOCK`` characters, so all else takes
time in proportion to the text and to the spans (times the logarithm of their number).

Edge cases: null and empty texts have no spans; overlapping spans of different kinds are all reported; repeated rows are
judged alike; an empty table gives an empty result; other columns pass through, but a column that has the result's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_or_empty

BASE = ("email", "ip", "card", "phone")
#: Per kind: what proposes a span.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: What a kind can't do without; looked for first, as that is cheaper.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
#: Score of a confirmed span, and what a context word within ``WINDOW`` characters before it adds.
SCORES = {"email": (0.95, 0.05), "ip": (0.7, 0.2), "card": (0.8, 0.2), "phone": (0.7, 0.2), "iban": (0.8, 0.2), "ssn": (0.4, 0.5), "secret": (0.4, 0.5)}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|master|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social|security|tax",
    "secret": "token|secret|passw|api.?key|credential|private",
}
WINDOW, LEAST = 40, 0.6
#: Characters of a block from which pieces of a text are cut.
BLOCK = 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    n = F.length(d)
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + part(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _mod97(m: Column) -> Column:
    s = F.translate(m, " ", "")
    s = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    code = lambda i: F.ascii(F.substring(s, i, F.lit(1)))
    step = lambda a, i: F.when(code(i) < 58, (a * 10 + code(i) - 48) % 97).otherwise((a * 100 + code(i) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})(?:\.|$)){4}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|0000$"),
    "secret": lambda m: (F.length(m) <= 256) & m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
}


def _running(values: Column, op) -> Column:
    """``op`` (sum or greatest) of each number and all before it: with those 1, 2, 4 ... places before, until all are in."""
    n = F.size(values)
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, values, lambda acc, step: F.transform(acc, lambda x, i: op(x, F.coalesce(F.get(acc, i - step), F.lit(0)))))


def _let(body, **values: Column) -> Column:
    """``body`` of a struct of values, each worked out once; a lambda would work out again for each element what stands inside it."""
    return F.transform(F.array(F.struct(*(c.alias(k) for k, c in values.items()))), body)[0]


def _last(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def _spans(text: Column, found: Column, kind: str) -> Column:
    """Confirmed spans of a kind, in order: the text between matches gives their places and what stands before them."""
    between = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    sizes = F.zip_with(between, found, lambda gap, m: F.length(gap) + F.length(m))
    parts = F.arrays_zip(_running(sizes, lambda a, b: a + b).alias("stop"), found.alias("m"), between.alias("gap"))
    ends = F.zip_with(between, found, lambda gap, m: F.concat(_last(gap, WINDOW), _last(m, WINDOW)))
    base, more = SCORES[kind]

    def scored(ends: Column, x: Column, i: Column) -> Column:
        # No match is shorter than five characters, so eight matches and what is between them reach back far enough.
        before = F.slice(ends, F.greatest(i - 7, F.lit(1)), F.least(i, F.lit(8)))
        near = F.lower(_last(F.concat(F.array_join(before, ""), _last(x["gap"], WINDOW)), WINDOW))
        score = F.when(near.rlike(CONTEXT[kind]), base + more).otherwise(base)
        return F.when(VALID[kind](x["m"]), F.struct(F.lit(kind).alias("kind"), (x["stop"] - F.length(x["m"])).alias("start"), x["stop"].alias("stop"), score.alias("score")))

    placed = F.filter(_let(lambda v: F.transform(v["parts"], lambda x, i: scored(v["ends"], x, i)), parts=parts, ends=ends), lambda x: x.isNotNull())
    return placed if kind in BASE else F.filter(placed, lambda x: x["score"] >= LEAST)


def find_pii(docs: DataFrame, into: str = "pii") -> DataFrame:
    """``docs`` with ``into``: array of (kind, start, stop, score), by kind, then start."""
    kind = "array<struct<kind:string,start:int,stop:int,score:double>>"
    none = F.array().cast(kind)
    text = text_or_empty()
    names = dict(zip(PATTERNS, fresh(docs, *PATTERNS)))
    found = docs
    for k, p in PATTERNS.items():
        all_ = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        found = found.withColumn(names[k], F.when(F.contains(text, F.lit(NEEDS[k])), all_) if k in NEEDS else all_)
    each = [F.when(F.size(names[k]) > 0, _spans(text, F.col(names[k]), k)).otherwise(none) for k in PATTERNS]
    return found.withColumn(into, F.concat(*each)).drop(*names.values())


def redact(docs: DataFrame, pii: str = "pii") -> DataFrame:
    """``docs`` of ``find_pii`` with each covered stretch of ``text`` replaced by its kind in angle brackets; ``n_chars`` follows where there is such a column."""
    text, (clean,) = F.col("text"), fresh(docs, "clean")
    spans = F.array_sort(pii, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(parts: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        some = F.slice(parts, first + 1, F.greatest(F.ceil(b / BLOCK).cast("int") - first, F.lit(0)))
        return F.substring(F.array_join(some, ""), a - first * BLOCK + 1, b - a)

    def stretches(v: Column) -> Column:
        """Spans that none before them reaches, each with the end of what is covered before it."""
        each = F.transform(v["spans"], lambda x, i: F.struct(F.coalesce(F.get(v["reach"], i - 1), F.lit(0)).alias("from"), x["start"].alias("start"), x["kind"].alias("kind")))
        return _let(rebuilt, heads=F.filter(each, lambda x: x["start"] >= x["from"]), end=F.element_at(v["reach"], -1), parts=blocks, size=F.length(text))

    def rebuilt(v: Column) -> Column:
        pieces = F.transform(v["heads"], lambda x: F.concat(cut(v["parts"], x["from"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.concat(F.array_join(pieces, ""), cut(v["parts"], v["end"], v["size"]))

    reached = lambda v: _let(stretches, spans=v["spans"], reach=_running(F.transform(v["spans"], lambda x: x["stop"]), F.greatest))
    some = F.size(pii) > 0
    out = docs.withColumn(clean, F.when(some, _let(reached, spans=spans)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(clean)).drop(clean, pii)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))
