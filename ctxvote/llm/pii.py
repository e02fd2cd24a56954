"""Personal data by patterns, checksum validators and context words, in DataFrame functions only.

A regular expression proposes spans per kind, a validator (Luhn, mod-97, number ranges, digit counts) confirms
them, and words near a span raise its score.  The four base kinds are kept whenever they are confirmed; the kinds
that are too weak alone (`ssn`, `phone_local`) need their context words to reach `MIN_SCORE`.

Everything happens inside one row, so there is no shuffle.  Positions are code points: a text is split by the
same pattern that finds the matches, and a match starts after the summed lengths of what stands before it.
The patterns are written with possessive quantifiers and look-behinds so that matching is linear in the text;
`\\G` lets a match start where the last one ended, as leftmost non-overlapping matching asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, characters without which it cannot match, score, context words, their bonus.
KINDS: list[tuple[str, str, str, float, str, float]] = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"(?i)\b(e-?mail|mailto|contact|write|adresse|correo)\b", 0.1),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", 0.7, r"(?i)\b(ip|host|server|address|login|from)\b", 0.2),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.9, r"(?i)\b(card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b", 0.1),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.8, r"(?i)\b(phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b", 0.2),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])", "", 0.8, r"(?i)\b(iban|bank|account|konto|compte|cuenta)\b", 0.2),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"(?i)\b(ssn|social security|taxpayer)\b", 0.4),
    ("phone_local", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]?[0-9])", "", 0.3, r"(?i)\b(phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b", 0.4),
]

BASE_KINDS = 4
MIN_SCORE = 0.5
CONTEXT = 40
_BLOCK = 64


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its mod-97 check."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _byte_part(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), _byte_part)
    if kind == "card":
        digits = _only_digits(hit)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_only_digits(hit)).between(10, 15)
    if kind == "iban":
        bare = F.replace(hit, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def _before(lengths: Column, sums: Column, i: Column) -> Column:
    """The sum of the first `i` lengths, from sums of whole blocks and the rest of one block."""
    block = F.floor(i / _BLOCK).cast("int")
    rest = F.slice(lengths, block * _BLOCK + 1, i - block * _BLOCK)
    return F.element_at(sums, block + 1) + F.aggregate(rest, F.lit(0), lambda a, x: a + x)


def _block_sums(lengths: Column) -> Column:
    """0, the sum of the first block, of the first two blocks, ..."""
    def add(acc: Column, b: Column) -> Column:
        block = F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))
        return F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(block, F.lit(0), lambda a, x: a + x)))

    blocks = F.floor(F.size(lengths) / _BLOCK).cast("int")
    return F.when(blocks == 0, F.array(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), blocks - 1), F.array(F.lit(0)), add))


_SPAN = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and `spans`, sorted by start and then kind in the order of `KINDS`.

    A span holds start and end (code points, end exclusive), kind, and score.  Base kinds follow their patterns
    and validators alone; the other kinds count when they reach `MIN_SCORE` and overlap no base span.  Null and
    empty texts have no spans; rows that repeat an id are separate rows; other columns are not read.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    empty = F.array().cast("array<string>")
    hits = {}
    for kind, pattern, needed, *_ in KINDS:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        hits[f"h_{kind}"] = F.when(F.contains("text", F.lit(needed)), found).otherwise(empty) if needed else found
    df = df.withColumns(hits)
    # Most texts have no match of a kind: only the others are split.
    df = df.withColumns({f"p_{k[0]}": F.when(F.size(f"h_{k[0]}") > 0, F.split("text", k[1], -1)).otherwise(empty) for k in KINDS})
    # Gap and match lengths alternate, so a match starts after an odd number of them.
    lengths = {}
    for kind, *_ in KINDS:
        zipped = F.zip_with(F.col(f"p_{kind}"), F.col(f"h_{kind}"), lambda p, h: F.array(F.length(p), F.coalesce(F.length(h), F.lit(0))))
        lengths[f"l_{kind}"] = F.flatten(zipped)
    df = df.withColumns(lengths)
    df = df.withColumns({f"s_{k[0]}": _block_sums(F.col(f"l_{k[0]}")) for k in KINDS})

    def spans_of(n: int) -> Column:
        kind, _, _, score, words, bonus = KINDS[n]
        pieces, lens, sums = F.col(f"p_{kind}"), F.col(f"l_{kind}"), F.col(f"s_{kind}")

        def span(hit: Column, i: Column) -> Column:
            near = F.concat_ws(" ", F.right(F.element_at(pieces, i + 1), F.lit(CONTEXT)), F.left(F.element_at(pieces, i + 2), F.lit(CONTEXT)))
            start = _before(lens, sums, 2 * i + 1)
            total = F.when(near.rlike(words), F.lit(score + bonus)).otherwise(F.lit(score))
            made = F.struct(start.cast("int").alias("start"), F.lit(n).alias("ord"), (start + F.length(hit)).cast("int").alias("end"), F.lit(kind).alias("kind"), total.alias("score"))
            return F.when(_valid(kind, hit), made)

        made = F.filter(F.transform(f"h_{kind}", span), lambda s: s.isNotNull())
        return F.when(F.size(f"h_{kind}") > 0, made).otherwise(F.array().cast(_SPAN))

    df = df.select("doc_id", *[spans_of(n).cast(_SPAN).alias(f"x_{k[0]}") for n, k in enumerate(KINDS)])
    base = F.concat(*[F.col(f"x_{k[0]}") for k in KINDS[:BASE_KINDS]])
    extra = F.concat(*[F.col(f"x_{k[0]}") for k in KINDS[BASE_KINDS:]])
    df = df.select("doc_id", base.alias("base"), F.filter(extra, lambda s: s["score"] >= MIN_SCORE).alias("extra"))
    free = F.filter("extra", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return df.select("doc_id", F.array_sort(F.concat("base", F.when(F.size("extra") > 0, free).otherwise(F.col("extra")))).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        grown = F.struct(F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], grown).otherwise(acc)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
