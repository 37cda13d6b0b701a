"""Quality rules with thresholds that adapt to language and source.

All work is done by DataFrame operations. Per language and source, mergeable quantile
sketches (percentile_approx) of a few ratios give fences, on either side of what fixed
cutoffs would be; documents are joined with the fences of their group and filtered. A
group's quantiles are pooled with those of its language, and these with all documents',
by weight: there is no size at which a group changes its rule.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Words of a window that counts as repeated.
WINDOW = 8
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Accuracy of the sketches: the rank error is a share 1/ACCURACY of a group.
ACCURACY = 10_000
#: Documents that the parent's quantiles weigh in a group's.
PRIOR = 200.0


class Fence(NamedTuple):
    """The upper fence is the median plus reach times its distance to the quantile
    1 - outer, that distance at least least; the lower, with the quantile outer, in the same
    way. least is for ratios that are 0 in nearly all documents of a group."""

    outer: float
    reach: float
    least: float
    lower: bool = False


RATIOS = {
    "symbol_ratio": Fence(0.1, 4.0, 0.01),
    "dup_line_ratio": Fence(0.02, 4.0, 0.05),
    "repeat_ratio": Fence(0.02, 4.0, 0.03),
    "mean_word": Fence(0.25, 8.0, 0.05, True),
}
#: Columns that features and judge add.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *RATIOS, "n_group", "kept"]

_SPACE = r"[\x20\x09-\x0D]+"


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (default: doc_id, lang, source) with n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words (long), base_failed and the ratios of each whole
    text.

    Null and empty texts have no words and null ratios; every row of docs gives a row, and
    an empty table none. A column of keep that is named like one of these gets the suffix
    _in. Repeated windows are found by sorting a text's window hashes, so that a long text
    costs n log n.
    """
    keep = ["doc_id", "lang", "source"] if keep is None else keep
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], text.alias("__t"))
    d = d.withColumn("__trim", F.btrim("__t", F.lit(" \t\n\x0b\f\r")))
    d = d.withColumn("__words", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", _SPACE)))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    d = d.withColumn("__lines", F.when(F.contains("__t", F.lit("\n")), lines))
    grams = F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)]))
    d = d.withColumn("__grams", F.when(F.size("__words") > WINDOW, grams))
    d = d.select(
        *[f"__k{i}" for i in range(len(keep))],
        "n_words",
        F.length(F.regexp_replace("__t", _SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.coalesce(F.size("__lines") - F.size(F.array_distinct("__lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), F.array_sort(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__sorted"),
        F.coalesce(F.size("__lines"), F.lit(1)).alias("__n_lines"),
    )
    again = F.filter("__sorted", lambda x, k: F.coalesce(F.get("__sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__sorted", k + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("__at", F.array_sort(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("__at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return d.select(
        *[F.col(f"__k{i}").alias(f"{c}_in" if c.lower() in MEASURES else c) for i, c in enumerate(keep)],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.try_divide(F.col("n_symbols").cast("double"), F.col("word_chars")).alias("symbol_ratio"),
        F.try_divide(F.col("n_dup_lines").cast("double"), F.col("__n_lines")).alias("dup_line_ratio"),
        F.try_divide(F.col("n_repeat_words").cast("double"), F.col("n_words")).alias("repeat_ratio"),
        F.try_divide(F.col("word_chars").cast("double"), F.col("n_words")).alias("mean_word"),
    )


def fences(feats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, n_group, <ratio>_high, <ratio>_low) for each language and source of
    feats, null ones too. Only documents that pass the base rules feed the sketches, which
    each task builds for itself and merges after one row per group and task. Where no
    document passes, fences are null and hold nobody back.

    feats is read more than once: if it isn't a staged table, its ratios are staged first.
    """
    groups = [F.col(lang).alias("lang"), F.col(source).alias("source")]
    if not hasattr(feats, "_staged_at"):
        feats = stage(feats.select(F.col(lang), F.col(source), "base_failed", *RATIOS), "quality-ratios")
    feats = feats.select(*groups, "base_failed", *RATIOS)
    sketches = [F.percentile_approx(r, F.array(F.lit(f.outer), F.lit(0.5), F.lit(1 - f.outer)), F.lit(ACCURACY)).alias(r) for r, f in RATIOS.items()]
    rolled = feats.where(~F.col("base_failed")).rollup("lang", "source").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *sketches)
    rolled = stage(rolled, "quality-sketches")  # a row per group, language and one for all
    out = feats.select("lang", "source").distinct()
    out = out.join(F.broadcast(rolled.where("g = 3").select(F.struct("n", *RATIOS).alias("all"))), F.lit(True), "left")
    for g, keys, name in ((1, ["lang"], "by_lang"), (0, ["lang", "source"], "own")):
        part = rolled.where(F.col("g") == g).select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct("n", *RATIOS).alias(name))
        on = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"__{k}"))
            on = same if on is None else on & same
        out = out.join(part, on, "left").drop(*[f"__{k}" for k in keys])

    def pooled(part: str, r: str, above: Column) -> Column:
        n = F.col(f"{part}.n")
        both = F.zip_with(F.col(part)[r], above, lambda x, y: (n * x + F.lit(PRIOR) * y) / (n + F.lit(PRIOR)))
        return F.when(F.col(part).isNull(), above).otherwise(both)

    highs, lows = [], []
    for r, f in RATIOS.items():
        out = out.withColumn(f"q_{r}", pooled("own", r, pooled("by_lang", r, F.col("all")[r])))
        low, middle, high = (F.get(f"q_{r}", i) for i in range(3))
        highs.append((middle + F.lit(f.reach) * F.greatest(F.lit(f.least), high - middle)).alias(f"{r}_high"))
        lower = middle - F.lit(f.reach) * F.greatest(F.lit(f.least), middle - low)
        lows.append((lower if f.lower else F.lit(None).cast("double")).alias(f"{r}_low"))
    return out.select("lang", "source", F.coalesce("own.n", F.lit(0)).cast("long").alias("n_group"), *highs, *lows)


def judge(feats: DataFrame, at: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """feats with n_group and kept: false if base_failed or a ratio is beyond a fence of its
    group. A null ratio (no words) is beyond none. Null languages and sources are groups."""
    named = {"lang": "__at_lang", "source": "__at_source", **{f"{r}_{side}": f"__{r}_{side}" for r in RATIOS for side in ("high", "low")}}
    at = at.withColumnsRenamed(named)
    joined = feats.join(at, feats[lang].eqNullSafe(at["__at_lang"]) & feats[source].eqNullSafe(at["__at_source"]))
    inside = F.lit(True)
    for r in RATIOS:
        inside = inside & F.coalesce(F.col(r) <= F.col(f"__{r}_high"), F.lit(True)) & F.coalesce(F.col(r) >= F.col(f"__{r}_low"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop(*named.values())


def assess(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (default: doc_id), measures, n_group and verdict of every row of
    docs: one pass over the texts, whose features are written to shared storage, then small
    aggregates and a join. Columns of keep are named as in features."""
    keep = ["doc_id"] if keep is None else keep
    named = docs.withColumns({"__lang": F.col(lang_col).cast("string"), "__source": F.col(source_col).cast("string")})
    feats = stage(features(named, text_col, [*keep, "__lang", "__source"]), "quality-features")
    at = stage(fences(feats, "__lang", "__source"), "quality-fences")
    return judge(feats, at, "__lang", "__source").drop("__lang", "__source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of documents that are kept, with all their columns, whatever these are named.
    Features are computed once and written beside the rows; no text is shuffled. Repeated
    rows stay repeated."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    named = docs.select(F.col("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), whole)
    rows = stage(features(named, keep=["__row", "lang", "source"]), "quality-rows")
    return judge(rows, stage(fences(rows), "quality-fences")).where("kept").select("__row.*")
