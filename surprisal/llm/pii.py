"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (part range of addresses, Luhn for cards,
digit counts for phones, mod-97 for account numbers, letters and digits in secrets), and words within
CONTEXT_CHARS before or after a span adjust its score: words of its kind raise it, words of other
things (a commit, a part number) lower it, and so do known prefixes of keys. Spans of the four base
kinds always stay once confirmed; spans of the added kinds stay with a score of MIN_SCORE, so a bare
run of letters and digits is no secret, and is one behind `API_KEY=` or before `is my password`.

The patterns are linear-time forms of the plain ones: a run of characters that can only be entered at
its beginning is not tried again from its middle, and deterministic repeats are possessive, which
also keeps Java's matcher from recursing over long texts.

Positions come from the texts between matches: split() and regexp_extract_all() with one pattern
interleave, so a running sum of their lengths gives code-point offsets. The sum goes block by block,
which keeps a text with very many matches near-linear.

Defined results: a null text has no spans; repeated rows each get theirs; overlapping spans of
different kinds are all reported, and redacted as one stretch named after the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret")
KINDS = BASE + ADDED
MIN_SCORE = 0.5
CONTEXT_CHARS = 40
BLOCK = 256
#: The column that find() adds; named so that no column of the documents clashes.
SPANS = "__pii_spans"

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}+",
}
#: A cheap necessary condition of each pattern; a secret needs a word or a prefix to reach MIN_SCORE.
GATES = {"email": "@", "phone": "+"}
PREFIX = r"^(?:AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|AIza[0-9A-Za-z_-]{30}|gh[opsu]_[0-9A-Za-z]{30}|glpat-|sk-[0-9A-Za-z_-]{20}|xox[abprs]-|eyJ[0-9A-Za-z_-]{12})"
SECRET_WORDS = r"token|secret|passw|pwd|api.?key|access.?key|credential|bearer"
SECRET_GATE = rf"(?i:{SECRET_WORDS})|AKIA|ASIA|AIza|gh[opsu]_|glpat-|sk-|xox[abprs]-|eyJ"
#: Of each kind: the score without context; what words of the kind add; what words of other things take away.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.6, "secret": 0.3}
RAISE, LOWER_BY, KNOWN = 0.3, 0.3, 0.5
CONTEXT = {
    "email": r"mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|master|amex|payment",
    "phone": r"phone|\btel|call|mobile|fax",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "secret": SECRET_WORDS,
}
OTHER = {
    "email": r"example\.",
    "ip": r"version|release|section",
    "card": r"order|serial|isbn|tracking",
    "phone": r"order|serial|isbn",
    "iban": r"serial|part.?n|sku|model|isbn",
    "secret": r"commit|checksum|digest|sha-?(?:1|256)|md5|uuid|https?:",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    """Remainder of an account number: four characters go behind, letters count 10 to 35."""
    bare = F.regexp_replace(x, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _valid(kind: str, x: Column) -> Column:
    """Whether a proposed text passes its kind's validator."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(x)
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(x, " ", "")).between(15, 34) & (_mod97(x) == 1)
    if kind == "secret":
        return x.rlike("[0-9][^0-9]*[0-9]") & x.rlike("[A-Za-z]")
    return F.lit(True)


def _spans(kind: str, gaps: Column, matches: Column) -> Column:
    """array<struct<s, e, kind, score>> of confirmed matches; needs at least one match."""
    rank = KINDS.index(kind)
    before = F.concat(F.array(F.lit("")), matches)
    told = F.zip_with(  # what stands before a match (another match of the kind included), and after it
        F.slice(F.zip_with(before, gaps, lambda m, g: F.concat(F.right(m, F.lit(CONTEXT_CHARS)), F.right(g, F.lit(CONTEXT_CHARS)))), F.lit(1), F.size(matches)),
        F.slice(gaps, F.lit(2), F.size(matches)),
        lambda b, g: F.lower(F.concat(F.right(b, F.lit(CONTEXT_CHARS)), F.lit("\n"), F.substring(g, 1, CONTEXT_CHARS))),
    )
    sized = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m"), m.alias("x")))
    pieces = F.zip_with(sized, told, lambda p, t: F.struct(p["g"].alias("g"), p["m"].alias("m"), p["x"].alias("x"), t.alias("near")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda b: F.slice(pieces, b * BLOCK + 1, BLOCK))
    item = lambda p, at: F.struct((at + p["g"]).alias("s"), F.lit(rank).alias("k"), (at + p["g"] + p["m"]).alias("e"), p["x"].alias("x"), p["near"].alias("near"))
    empty = F.expr("cast(array() AS array<struct<s: bigint, k: int, e: bigint, x: string, near: string>>)")
    place = lambda block, base: F.aggregate(
        block,
        F.struct(base.alias("pos"), empty.alias("out")),
        lambda a, p: F.struct((a["pos"] + p["g"] + p["m"]).alias("pos"), F.concat(a["out"], F.array(item(p, a["pos"]))).alias("out")),
        lambda a: a["out"],
    )
    size = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, p: a + p["g"] + p["m"])
    longs = F.expr("cast(array() AS array<bigint>)")
    placed = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("pos"), longs.alias("out")),
        lambda a, b: F.struct((a["pos"] + size(b)).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")),
        lambda a: F.flatten(F.zip_with(blocks, a["out"], place)),
    )
    raised = lambda p: F.when(p["near"].rlike(CONTEXT[kind]), RAISE).otherwise(0.0) - F.when(p["near"].rlike(OTHER[kind]), LOWER_BY).otherwise(0.0)
    known = lambda p: F.when(p["x"].rlike(PREFIX), KNOWN).otherwise(0.0) if kind == "secret" else F.lit(0.0)
    score = lambda p: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(PRIOR[kind]) + raised(p) + known(p))), 2)
    keep = lambda p: _valid(kind, p["x"]) & (F.lit(True) if kind in BASE else score(p) >= MIN_SCORE)
    return F.transform(F.filter(placed, keep), lambda p: F.struct(p["s"], p["k"], p["e"], score(p).alias("score")))


SPAN = "array<struct<s: bigint, k: int, e: bigint, score: double>>"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column SPANS: the spans of every row, sorted by start and kind; k numbers KINDS, e is exclusive."""
    own = {k: f"__pii_{k}" for k in KINDS}
    none = F.expr("cast(array() AS array<string>)")
    gate = {k: F.contains(F.col(text), F.lit(v)) for k, v in GATES.items()} | {"secret": F.col(text).rlike(SECRET_GATE)}
    found = {own[k]: F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k]), F.lit(0)) for k in KINDS}
    found = {c: F.when(gate[k], found[c]).otherwise(none) if (k := c[6:]) in gate else found[c] for c in found}
    out = docs.withColumns(found)
    gaps = {f"{c}_g": F.when(F.size(F.col(c)) > 0, F.split(F.col(text), PATTERNS[c[6:]], -1)) for c in own.values()}
    out = out.withColumns(gaps)
    spans = {f"{c}_s": F.when(F.size(F.col(c)) > 0, _spans(k, F.col(f"{c}_g"), F.col(c))).otherwise(F.expr(f"cast(array() AS {SPAN})")) for k, c in own.items()}
    out = out.withColumns(spans)
    out = out.withColumn(SPANS, F.array_sort(F.concat(*(F.coalesce(F.col(c), F.expr(f"cast(array() AS {SPAN})")) for c in spans))))
    return out.drop(*found, *gaps, *spans)


def _name(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), k + 1)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", _name(p["k"]), p["s"], p["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, a digest of them, all spans as text, and their scores in the same order."""
    base = F.filter(SPANS, lambda p: p["k"] < len(BASE))
    count = lambda i: F.size(F.filter(SPANS, lambda p: p["k"] == i)).cast("long")
    return find(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col(SPANS)).alias("spans"),
        F.array_join(F.transform(SPANS, lambda p: p["score"].cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; rows without spans keep their text, n_chars follows."""
    t = F.col(text)
    first = F.struct(F.lit(0).cast("long").alias("pos"), F.expr("cast(array() AS array<string>)").alias("out"))
    piece = lambda a, p: F.array(t.substr((a["pos"] + 1).cast("int"), (p["s"] - a["pos"]).cast("int")), F.concat(F.lit("["), F.upper(_name(p["k"])), F.lit("]")))
    none = F.expr("cast(array() AS array<string>)")
    step = lambda a, p: F.struct(F.greatest(a["pos"], p["e"]).alias("pos"), F.concat(a["out"], F.when(p["s"] >= a["pos"], piece(a, p)).otherwise(none)).alias("out"))
    end = lambda a: F.concat(F.array_join(a["out"], ""), t.substr((a["pos"] + 1).cast("int"), F.length(t)))
    cleaned = F.when(F.size(SPANS) > 0, F.aggregate(SPANS, first, step, end)).otherwise(t)
    out = find(docs, text).withColumn(text, cleaned).drop(SPANS)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out
