"""Personal data found by DataFrame operations alone.

Regular expressions propose spans, checksums (Luhn, mod-97) confirm them and words
nearby adjust their score. Expressions are possessive and anchored to run starts, so
that long runs of letters or digits are read once and without recursion. Places are
running sums of pieces' lengths, each array computed once: a text costs time in
proportion to its length and matches (and n log n to sort these).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

#: Code points on either side of a span in which context words count.
CONTEXT = 48
#: What a context word adds to a score, and the score that kinds beyond the base need.
BOOST, LEAST_SCORE = 0.25, 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    base: bool
    hint: str  # a text without it has no match

    def valid(self, value: Column) -> Column:
        digits = F.regexp_replace(value, "[^0-9]", "")
        if self.name == "ip":
            return ~F.exists(F.split(value, r"\."), lambda x: ~x.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
        if self.name == "card":
            return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
        if self.name == "phone":
            return F.length(digits).between(9, 15)
        if self.name == "iban":
            return mod97(F.regexp_replace(value, " ", "")) == 1
        return F.lit(True)


#: The base kinds in their order, then those that the method adds.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"\b(?:e-?mail|mail|contact|write to|schreib|correo)", True, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server", True, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, r"card\b|\b(?:visa|credit|carte|tarjeta)|karte\b", True, ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"phone\b|\b(?:call|tel|mobile|fax)\b", True, "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.75, r"\b(?:iban|account|bank|konto|cuenta|compte)", False, ""),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"\bssn\b|social security", False, "-"),
)

#: Numbers in a block of the running sum.
BLOCK = 128


def mod97(value: Column) -> Column:
    """The number of an account identifier, its first four characters last and A-Z as 10-35, modulo 97."""
    moved = F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _running(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """Adds out: for each place of an array column the sum of the numbers before it, in
    blocks, so that long arrays don't cost their square."""
    zero = F.lit(0)
    add = lambda acc, x: acc + x
    blocks = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), zero, add))
    df = df.withColumn(f"{out}_b", once(F.when(F.size(lengths) > 0, blocks)))
    df = df.withColumn(f"{out}_p", once(F.transform(f"{out}_b", lambda _, b: F.aggregate(F.slice(f"{out}_b", 1, b), zero, add))))
    at = lambda _, i: F.get(f"{out}_p", F.floor(i / BLOCK).cast("int")) + F.aggregate(F.slice(lengths, i - i % BLOCK + 1, i % BLOCK), zero, add)
    return df.withColumn(out, once(F.transform(lengths, at))).drop(f"{out}_b", f"{out}_p")


def _length_with(pieces: str):
    return lambda x, j: F.length(F.get(pieces, j)) + F.length(x)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, spans) per row of docs; spans: array of (start, kind number, end, kind,
    score, base) in order of start, then kind. Places are code points, the end exclusive.

    Base kinds are kept whatever their score; the others need LEAST_SCORE. Null and
    empty texts have no spans; repeated rows give repeated rows. No shuffle.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    d = d.withColumn("__digit", F.col("__t").rlike("[0-9]"))
    for i, k in enumerate(kinds):
        m, p, n, s = f"__m{i}", f"__p{i}", f"__n{i}", f"__s{i}"
        maybe = F.contains("__t", F.lit(k.hint)) if k.hint else F.lit(True)
        if k.name != "email":
            maybe = maybe & F.col("__digit")
        d = d.withColumn(m, once(F.when(maybe, F.regexp_extract_all("__t", F.lit(k.pattern), 0))))
        d = d.withColumn(p, once(F.when(F.size(m) > 0, F.split("__t", k.pattern, -1))))
        d = d.withColumn(n, once(F.when(F.col(p).isNotNull(), F.transform(m, _length_with(p)))))
        d = _running(d, n, s)

        def span(x: Column, j: Column) -> Column:
            start = F.get(s, j) + F.length(F.get(p, j))
            near = F.lower(F.concat(F.right(F.get(p, j), F.lit(CONTEXT)), F.lit(" "), F.left(F.get(p, j + 1), F.lit(CONTEXT))))
            score = F.least(F.lit(1.0), F.when(near.rlike(k.context), k.score + BOOST).otherwise(k.score))
            return F.struct(start.alias("start"), F.lit(i).alias("rank"), (start + F.length(x)).alias("end"), F.lit(k.name).alias("kind"), score.alias("score"), F.lit(k.base).alias("base"), k.valid(x).alias("ok"))

        found = F.filter(F.transform(m, span), lambda x: x["ok"] & (x["base"] | (x["score"] >= LEAST_SCORE)))
        d = d.withColumn(m, once(F.when(F.col(p).isNotNull(), found))).drop(p, n, s)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean,ok:boolean>>")
    every = F.concat(*[F.coalesce(F.col(f"__m{i}"), empty) for i in range(len(kinds))])
    spans = F.transform(F.array_sort(every), lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"], x["score"], x["base"]))
    return d.select("doc_id", once(spans).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def pii_report(found: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("spans", _is(k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda x: x["score"])).alias("top_score"),
    )

