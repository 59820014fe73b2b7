"""Personal data: regular expressions propose spans, validators confirm them, words nearby adjust their score.

All of it is one projection over whole texts: no row moves. Of each kind the proposals are the leftmost non-overlapping
matches; one that its validator refuses is dropped, and what it covered is not tried again:

* email, ip (parts up to 255), card (13 to 19 digits that pass Luhn), phone (international, 9 to 15 digits): the base kinds;
* iban (the length of an IBAN, remainder 1 modulo 97) and ssn (areas, groups and serials that are issued): the added kinds.

A span's score is its kind's prior, and more if one of the kind's words stands in the `WINDOW` characters before it (back to
the match before, at most). Base spans stay whatever their score; an added one needs `THRESHOLD`, which an ssn, having no checksum,
only reaches beside such a word. Spans of different kinds may overlap. The base kinds propose by the patterns in `FIXED`,
written so that a long text costs time in proportion to its length and no recursion.

Null texts are empty and have no spans; repeated rows are scanned each by itself; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.tokens import bound
from tracewell.functions.vectors import running

#: How the base kinds are written.
FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WINDOW, THRESHOLD = 40, 0.5
_DIGITS = r"[^0-9]"


@dataclass(frozen=True)
class Kind:
    """pattern: proposals, for Java. sign: a plain text without which there are none ('' for any). lead: a character before the span that the pattern takes along."""

    name: str
    pattern: str
    prior: float
    gain: float
    words: str
    sign: str = ""
    lead: bool = False
    base: bool = True


#: The fixed patterns with possessive repeats. A match can only begin where a run of its first class does, or where the last match
#: ended, so runs are entered once. Cards shorter than 13 digits are left out at once: they are runs of their own.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, 0.2, "e-?mail|contact|write to|reach", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", 0.5, 0.3, r"\bip\b|address|host|server", "."),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){12,}+", 0.7, 0.3, "card|visa|master|credit|debit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, 0.3, "phone|call|tel|mobile|fax", "+"),
    Kind("iban", r"(^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)", 0.7, 0.3, "iban|account|bank|transfer", lead=True, base=False),
    Kind("ssn", r"(^|[^0-9A-Za-z+-])[0-9]{3}(?:-[0-9]++)++", 0.3, 0.4, r"\bssn\b|social security|tax id", "-", lead=True, base=False),
)


def mod97(value: Column) -> Column:
    """The remainder of an IBAN's number: its first four characters at the end, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")
    step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + c.cast("int")) % 97).when(c == "", r).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def confirmed(kind: str, value: Column) -> Column:
    """Whether a proposal is of its kind."""
    digits = F.regexp_replace(value, _DIGITS, "")
    match kind:
        case "ip":
            return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
        case "card":
            return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
        case "phone":
            return F.length(digits).between(9, 15)
        case "iban":
            return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(value) == 1)
        case "ssn":
            return value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(text: Column, kind: Kind) -> Column:
    """Spans of one kind in order. The pieces between the matches give their places: sums of lengths."""

    def placed(s: Column) -> Column:
        """Of a match and the piece before it; `before` is the number of characters before that piece."""
        def one(i: Column) -> Column:
            at = lambda a: F.get(s[a], i)
            value = F.regexp_replace(at("found"), "^[^A-Za-z0-9]", "") if kind.lead else at("found")
            end = at("before") + F.length(at("pieces")) + F.length(at("found"))
            near = F.lower(F.right(F.concat(at("pieces"), F.substring(at("found"), 1, 1)) if kind.lead else at("pieces"), F.lit(WINDOW)))
            score = F.round(kind.prior + F.when(near.rlike(kind.words), kind.gain).otherwise(0.0), 2)
            return F.struct(F.lit(kind.name).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), score.alias("score"), F.lit(kind.base).alias("base"), value.alias("value"))

        rows = F.transform(F.sequence(F.lit(0), F.size(s["found"]) - 1), one)
        keep = F.filter(rows, lambda r: confirmed(kind.name, r["value"]) & (F.lit(kind.base) | (r["score"] >= THRESHOLD)))
        return F.transform(keep, lambda r: F.struct(*[r[n].alias(n) for n in ("kind", "start", "end", "score", "base")]))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.sign:
        found = F.when(F.contains(text, F.lit(kind.sign)), found)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")

    def measured(found: Column) -> Column:
        pieces = F.split(text, kind.pattern, -1)
        lengths = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b))
        return bound(pieces, lambda p: F.struct(found.alias("found"), p.alias("pieces"), running(lengths(p)).alias("before")))

    return bound(found, lambda f: F.when(F.size(f) > 0, bound(measured(f), placed)).otherwise(none))


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the spans of each row's whole text, by kind in the order of KINDS, then by start, in code points, the end exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, F.concat(*[_spans(text, k) for k in KINDS]).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and a list of all spans, in place of the spans of scan_pii."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.sha2(listed(F.filter("spans", lambda s: s["base"])).cast("binary"), 256)
    return found.select("doc_id", *[of(k.name) for k in KINDS if k.base], base.alias("base_sha256"), listed(F.col("spans")).alias("spans"))
