r"""Personal data in text, found with Spark's own expressions only.

Three steps: regular expressions propose spans, validators confirm them (part size for
addresses, Luhn for card numbers, mod-97 for account numbers), and context words near a span
move its score. Base kinds that pass their validator always count; the added kinds (an
account number, a phone number without a plus sign, a secret key) need the score to reach
``MIN_SCORE``, so their context decides.

Positions come without a UDF: splitting a text at the matches of a pattern gives the gaps
between them, and gaps and matches in turn add up to the offsets, in code points.
The patterns take possessive repeats and start only where a run starts (or where the
previous match ended), so a long run of digits or letters costs linear time; they match
what the plain patterns match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
#: The order in which spans of equal start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "local_phone", "secret")
MIN_SCORE = 0.6
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap test: texts without a match of it have no span of this kind
    base_score: float
    context: str  # words near the span that raise the score
    against: str = ""  # words near the span that lower it


KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.95, "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.8, "ip|address|host|server", "version|release"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", 0.85, "card|credit|visa|payment", "order|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.85, "phone|tel|call|mobile|fax"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2}", 0.9, "iban|account|bank|konto|compte|cuenta"),
    Kind("local_phone", r"(?<![0-9+().-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", r"[0-9][\x20.)-]", 0.4, "phone|tel|call|mobile|fax|telefon|téléphone|teléfono"),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,64}(?![A-Za-z0-9])", r"[A-Za-z0-9]{32}", 0.3, "token|secret|api|key|password"),
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit counts twice."""
    ordered = F.reverse(F.filter(F.split(digits, ""), lambda d: d != ""))

    def add(total: Column, i: Column) -> Column:
        d = F.get(ordered, i).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an international account number passes its check: country and check digits moved
    to the end, letters counted as 10 to 35, the number must be 1 modulo 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, char: Column) -> Column:
        value = F.conv(char, 36, 10).cast("int")
        return F.when(value < 10, rest * 10 + value).otherwise(rest * 100 + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # long parts are cut of leading zeros first, so that no cast can overflow
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(m))
        return n.between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(m)
    if kind == "local_phone":
        return F.length(_digits(m)).between(7, 11)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind: array<struct<kind, rank, start, end, score>>, in order."""
    rank = [k.name for k in KINDS].index(kind.name)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    gaps = F.split(text, kind.pattern, -1)
    empty = F.array().cast("array<struct<match:string,start:int>>")
    seen = F.aggregate(
        F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
                F.concat(acc["spans"], F.array(F.struct(x["m"].alias("match"), (acc["at"] + F.length(x["g"])).alias("start")))).alias("spans"),
            )
        ),
        lambda acc: acc["spans"],
    )
    confirmed = F.filter(seen, lambda s: _valid(kind.name, s["match"]))

    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(text, first + 1, s["start"] - first))
        score = F.lit(kind.base_score) + F.when(near.rlike(rf"\b(?:{kind.context})"), 0.35).otherwise(0.0)
        if kind.against:
            score = score - F.when(near.rlike(rf"\b(?:{kind.against})"), 0.3).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"),
            (s["start"] + F.length(s["match"])).alias("end"), F.least(score, F.lit(1.0)).alias("score"),
        )

    out = F.transform(confirmed, scored)
    if kind.name in ADDED_KINDS:
        out = F.filter(out, lambda s: s["score"] >= MIN_SCORE)
    none = F.array().cast("array<struct<kind:string,rank:int,start:int,end:int,score:double>>")
    hint = F.contains(text, F.lit(kind.hint)) if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(hint, out).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text and ``spans``, sorted by start, then kind.

    A span is (kind, rank, start, end, score); offsets count code points, the end is
    exclusive. Base kinds are leftmost non-overlapping matches per kind; a match that fails
    its validator is dropped and not tried again shorter. Spans of different kinds may
    overlap; an added span that overlaps a base span is dropped. NULL text counts as empty.
    Repeated rows give repeated rows, other columns are ignored, nothing is shuffled.
    """
    text = F.col("text")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = base.select(
        "doc_id", "text",
        F.concat(*[_spans(text, k) for k in KINDS if k.name in BASE_KINDS]).alias("base"),
        F.concat(*[_spans(text, k) for k in KINDS if k.name in ADDED_KINDS]).alias("added"),
    )
    clear = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    by_start = F.array_sort(
        F.concat("base", clear),
        lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"]),
    )
    return found.select("doc_id", "text", by_start.alias("spans"))


def joined(spans: Column) -> Column:
    """The digest form of spans: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one mask,
    named for the first."""
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
    )
    whole = F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; all columns keep their names and order.
    NULL text stays NULL and empty text empty. ``n_chars``, where there is such a column, follows the new text. Each row
    is masked alone, where it is read: repeated rows stay repeated, an empty table stays empty; texts are read whole,
    in memory linear in their length and the number of matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = "__spans"
    while spans in docs.columns:
        spans += "_"
    base = F.concat(*[_spans(text, k) for k in KINDS])
    with_spans = docs.withColumn(spans, F.array_sort(base, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])))
    new = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(masked(F.col("text"), F.col(spans)))
    out = with_spans.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))
    return out.drop(spans)
