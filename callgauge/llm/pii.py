"""Personal data: patterns propose, checksums confirm, context words adjust the score.

All steps are Spark SQL expressions. Offsets come from the texts between matches: a
pattern's ``split`` and ``regexp_extract_all`` walk the same matches, so the running sum
of their lengths is the position. Matches travel one per row, not as one array per
document, so the work is linear in the number of matches.

Patterns are written so that a failed start is not tried again inside the same run of
characters (a look-behind, or ``\\G`` right after a match) and never backtracks into a
group; long runs of letters or digits stay linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm.common import fresh, text_or_empty

CONTEXT_CHARS = 48
BASE_KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``hint`` is a cheap test that every matching text passes; ``prior`` the score of a match that
    passed its checks; ``context`` words before it that raise the score.
    """

    name: str
    pattern: str
    hint: str
    prior: float
    context: str


# Length of an account number (IBAN) in each country, by length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Account numbers of their country's length, so that a word in capitals behind one stays out; others of any length."""
    known = []
    for length, codes in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        known.append(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    other = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(known)}|{other})(?![A-Za-z0-9])"


_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", "@", 0.9, "mail|contact|schreib"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, r"\bip\b|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+", "", 0.8, "card|visa|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobil|fax"),
    Kind(
        "iban",
        _iban_pattern(),
        "",
        0.7,
        "iban|account|konto|compte|cuenta",
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"ssn|social security"),
)
THRESHOLD = 0.6


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a right Luhn check digit."""
    def add(total, i):
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(i % 2 == 1, digit).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a code (letters and digits, no spaces) gives 1 modulo 97 after moving four characters to its end."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest, i):
        sign = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(sign >= 65, (rest * 100 + sign - 55) % 97).otherwise((rest * 10 + sign - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _valid(kind: Column, text: Column) -> Column:
    digits = _digits(text)
    small = F.forall(
        F.split(text, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.ltrim(p, F.lit("0")).try_cast("int") <= 255) | (F.ltrim(p, F.lit("0")) == "")
    )
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.length(digits).between(14, 19) & luhn(digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .when(kind == "iban", mod97(F.replace(text, F.lit(" "), F.lit(""))))
        .otherwise(F.lit(True))
    )


def _proposed(text: Column, kind: Kind) -> Column:
    """Matches of one kind as an array of (kind, i, gap, before, found): the length of the text before it since the last match, its end, the match."""
    pieces = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(pieces.alias("piece"), found.alias("found")),
        lambda x, i: F.struct(
            F.lit(kind.name).alias("kind"),
            i.alias("i"),
            F.length(x["piece"]).alias("gap"),
            F.when(x["found"].isNotNull(), F.lower(F.right(x["piece"], F.lit(CONTEXT_CHARS)))).alias("before"),
            x["found"].alias("found"),
        ),
    )
    kept = F.filter(rows, lambda x: x["found"].isNotNull())
    test = text.contains(kind.hint) if kind.hint else text.rlike(kind.pattern)
    return F.when(test, kept)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs`` (all its columns) with ``pii``: array of (start, rank, kind, end, score, found).

    Offsets count code points, the end is exclusive. Base kinds (email, ip, card, phone) are kept whenever their
    checks pass; the added ones (iban, ssn) also need a score of at least ``THRESHOLD``. A null or empty text gives
    an empty array, repeated rows give repeated rows, an empty table gives an empty one. A clash of column names is
    avoided by choosing other names for inner columns; ``pii`` replaces a column of that name.
    """
    docs = docs.drop("pii")
    rid, hit = fresh(docs, "_rid"), fresh(docs, "_hit")
    body = text_or_empty(text)
    proposed = F.flatten(F.array(*[F.coalesce(_proposed(body, k), F.array().cast("array<struct<kind:string,i:int,gap:int,before:string,found:string>>")) for k in KINDS]))
    keyed = docs.withColumn(rid, F.monotonically_increasing_id())
    names = ["rid", "kind", "i", "gap", "before", "found"]
    rows = keyed.select(F.col(rid).alias("rid"), F.explode(proposed).alias(hit)).select("rid", f"{hit}.*").toDF(*names)
    rank = F.array_position(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind"))
    order = "PARTITION BY rid, kind ORDER BY i"
    ends = F.expr(f"sum(gap + length(found)) OVER ({order})")
    prior = F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k.name, k.prior)]), F.col("kind"))
    words = F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k.name, k.context)]), F.col("kind"))
    near = F.expr("regexp_like(before, words)")
    spans = (
        rows.repartition("rid")
        .withColumn("end", ends)
        .filter(_valid(F.col("kind"), F.col("found")))
        .withColumn("words", words)
        .withColumn("score", F.least(F.lit(1.0), prior + F.when(near, 0.3).otherwise(0.0)))
        .filter(F.col("kind").isin(*BASE_KINDS) | (F.col("score") >= THRESHOLD))
        .select("rid", F.struct((F.col("end") - F.length("found")).alias("start"), rank.cast("int").alias("rank"), "kind", "end", "score", "found").alias("span"))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list("span")).alias("pii"))
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,found:string>>")
    found = spans.withColumnRenamed("rid", rid)
    return keyed.join(found, rid, "left").withColumn("pii", F.coalesce("pii", none)).drop(rid)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    count = {f"n_{k}": F.size(F.filter("pii", _of_kind(k))).cast("long") for k in BASE_KINDS}
    return find(docs.select("doc_id", "text")).select(
        "doc_id",
        *[c.alias(n) for n, c in count.items()],
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest(F.col("pii")).alias("spans"),
    )
