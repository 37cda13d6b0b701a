"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii as op

    return op.pii_report(op.find_pii(documents(spark, sf_dir)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_counts as op

    lengths = op.encoded_lengths(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return op.suffix_report(op.length_histogram(lengths))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses as op

    return op.license_report(op.scan_licenses(documents(spark, sf_dir)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination as op

    return op.contamination_report(op.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash_dedup as op

    return op.near_duplicates(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality as op

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return op.assess(documents(spark, sf_dir)).select(*columns, *op.RATIOS, "n_group")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup as op

    return op.remove_repeats(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing as op

    return op.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_finish")


#: The tokenizer's vocabulary and the id after each document.
TOKENIZER, VOCABULARY, END_ID = "word_bpe_49k.json", 49408, 2


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store as op

    path = write_token_store(spark, documents(spark, sf_dir))
    return op.read_documents(spark, path, VOCABULARY).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def write_token_store(spark: SparkSession, docs: DataFrame) -> str:
    import public_tokenizers

    from . import token_store as op

    path = new_path(spark, "token-store")
    op.write_store(docs, path, public_tokenizers.path(TOKENIZER), VOCABULARY, END_ID)
    return path


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id as op

    docs = documents(spark, sf_dir)
    sample = op.training_sample(docs)
    return op.identify(docs, op.train(sample) if sample else None)


#: Lower case for A-Z alone.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _near_duplicates_sql() -> str:
    """All pairs that share a shingle, counted; then what can be reached over links."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER}, {_WORD}) END AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
    FROM words, unnest(range(1, greatest(len(w), 2))) t(i) WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)"""


def _quality_sql() -> str:
    """Exact quantiles stand for the sketches: at the tables' size these are exact too."""
    from . import quality as q

    ratios = list(q.RATIOS)
    ranked = ", ".join(f"row_number() OVER (PARTITION BY g, lang, source ORDER BY {r} NULLS LAST) AS r_{r}, count({r}) OVER (PARTITION BY g, lang, source) AS n_{r}" for r in ratios)
    cuts, of_lang, of_group, inside = [], [], [], []
    pool = lambda x, n, up: f"CASE WHEN {n} IS NULL THEN {up} ELSE ({n} * {x} + {q.PRIOR!r}::DOUBLE * {up}) / ({n} + {q.PRIOR!r}::DOUBLE) END"
    for r, f in q.RATIOS.items():
        for name, at in (("lo", f.outer), ("mid", 0.5), ("hi", 1 - f.outer)):
            x = f"{r}_{name}"
            cuts.append(f"max(CASE WHEN r_{r} = greatest(1, ceil({at!r}::DOUBLE * n_{r})) THEN {r} END) AS {x}")
            of_lang.append(f"{pool(f'l.{x}', 'l.n', f'a.{x}')} AS {x}")
            of_group.append(f"{pool(f'o.{x}', 'o.n', f'p.{x}')} AS {x}")
        inside.append(f"coalesce({r} <= {r}_mid + {f.reach!r}::DOUBLE * greatest({f.least!r}::DOUBLE, {r}_hi - {r}_mid), TRUE)")
        if f.lower:
            inside.append(f"coalesce({r} >= {r}_mid - {f.reach!r}::DOUBLE * greatest({f.least!r}::DOUBLE, {r}_mid - {r}_lo), TRUE)")
    return f"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l FROM words),
grams AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM words, unnest(range(1, len(w) - 6)) t(i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, g FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (doc_id, g), range(0, 8) t(k) GROUP BY 1),
counted AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CASE WHEN contains(text, chr(10)) THEN len(l) ELSE 1 END AS n_lines
  FROM words JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
feats AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN CAST(n_symbols AS DOUBLE) / word_chars END AS symbol_ratio,
    CASE WHEN n_lines > 0 THEN CAST(n_dup_lines AS DOUBLE) / n_lines END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN CAST(n_repeat_words AS DOUBLE) / n_words END AS repeat_ratio,
    CASE WHEN n_words > 0 THEN CAST(word_chars AS DOUBLE) / n_words END AS mean_word FROM counted),
rolled AS (
  SELECT 0 AS g, lang, source, {", ".join(ratios)} FROM feats WHERE NOT base_failed
  UNION ALL SELECT 1, lang, NULL, {", ".join(ratios)} FROM feats WHERE NOT base_failed
  UNION ALL SELECT 2, NULL, NULL, {", ".join(ratios)} FROM feats WHERE NOT base_failed),
ranks AS (SELECT *, {ranked} FROM rolled),
quantiles AS (SELECT g, lang, source, CAST(count(*) AS DOUBLE) AS n, {", ".join(cuts)} FROM ranks GROUP BY 1, 2, 3),
named AS (SELECT DISTINCT lang, source FROM feats),
by_lang AS (
  SELECT x.lang, {", ".join(of_lang)} FROM (SELECT DISTINCT lang FROM named) x
  LEFT JOIN quantiles a ON a.g = 2 LEFT JOIN quantiles l ON l.g = 1 AND l.lang IS NOT DISTINCT FROM x.lang),
by_group AS (
  SELECT x.lang, x.source, CAST(coalesce(o.n, 0) AS BIGINT) AS n_group, {", ".join(of_group)} FROM named x JOIN by_lang p ON p.lang IS NOT DISTINCT FROM x.lang
  LEFT JOIN quantiles o ON o.g = 0 AND o.lang IS NOT DISTINCT FROM x.lang AND o.source IS NOT DISTINCT FROM x.source)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(inside)} AS kept,
  {", ".join(ratios)}, n_group
FROM feats v JOIN by_group f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source"""


def _contamination_sql() -> str:
    """Windows as texts, looked up among the documents' runs of as many words; nearness from
    the documents that hold all of a window's words."""
    from . import decontamination as d

    words = lambda table, key: f"SELECT {key}, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END AS w FROM {table}"
    return f"""
WITH docs AS ({words("documents", "doc_id")}), items AS ({words("benchmark", "item_id")}),
windows AS (
  SELECT item_id, least({d.WINDOW}, len(w)) AS l, list_slice(w, i, i + least({d.WINDOW}, len(w)) - 1) AS t, array_to_string(t, ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - {d.WINDOW - 1}, 1) + 1)) u(i) WHERE len(w) > 0),
kinds AS (SELECT DISTINCT l, g FROM windows),
runs AS (
  SELECT doc_id, i, k.l, array_to_string(list_slice(w, i, i + k.l - 1), ' ') AS g
  FROM docs, (SELECT DISTINCT l FROM kinds) k, unnest(range(1, len(w) - k.l + 2)) u(i)),
hits AS (SELECT doc_id, i, l, g FROM runs JOIN kinds USING (l, g)),
hit_words AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, unnest(range(0, l)) u(k) GROUP BY 1),
hit_items AS (
  SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS x FROM (SELECT DISTINCT doc_id, g FROM hits) JOIN windows USING (g) WHERE item_id IS NOT NULL GROUP BY 1),
terms AS (SELECT DISTINCT g, unnest(t) AS word, len(list_distinct(t)) AS n FROM windows),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
could AS (SELECT doc_id, g FROM (SELECT DISTINCT doc_id, word FROM places) JOIN terms USING (word) GROUP BY doc_id, g HAVING count(*) = max(n)),
found AS (SELECT c.doc_id, c.g, t.n, t.word, p.i FROM could c JOIN terms t ON t.g = c.g JOIN places p ON p.doc_id = c.doc_id AND p.word = t.word),
near AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT a.doc_id, a.g, a.i FROM found a JOIN found b ON b.doc_id = a.doc_id AND b.g = a.g AND b.i BETWEEN a.i AND a.i + {2 * d.WINDOW - 1}
    GROUP BY a.doc_id, a.g, a.i HAVING count(DISTINCT b.word) = max(a.n))),
near_items AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM near JOIN windows USING (g) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, CAST(coalesce(len(i.x), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(i.x, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, coalesce(e.n, 0) AS n_near_items
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id) LEFT JOIN near_items e USING (doc_id)"""


def _mixing_sql() -> str:
    from . import mixing as m

    return f"""
WITH sized AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, {_WORD})) END AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
named AS (SELECT *, {list(m.WEIGHTS)}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(m.WEIGHTS)} + 1 AS INT)] AS weight FROM per),
sorted AS (
  SELECT *, {m.PASSES} * source_size AS cap, {m.BUDGET}e0 * sum(source_size) OVER () AS total, row_number() OVER o AS k,
    coalesce(sum({m.PASSES} * source_size) OVER (ORDER BY {m.PASSES}e0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY {m.PASSES}e0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM named WINDOW o AS (ORDER BY {m.PASSES}e0 * source_size / weight, source NULLS LAST)),
levels AS (SELECT *, (total - capped) / rest AS lv FROM sorted),
targets AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(lv, k) FROM levels WHERE lv * weight <= cap)), CAST(cap AS DOUBLE)) AS target FROM levels),
queued AS (
  SELECT doc_id, s.source, size, source_size, target, md5('mix:' || doc_id) AS tag,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source),
packets AS (
  SELECT doc_id, q.source, tag, least({m.PACKET}, size - b.first) AS words,
    (p * source_size + earlier + b.first + least({m.PACKET}, size - b.first)) / target AS finish
  FROM queued q, range(0, {m.PASSES}) a(p), unnest(range(0, size, {m.PACKET})) b(first) WHERE size > 0),
served AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, source, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM packets WHERE finish < 2),
cut AS (
  SELECT doc_id, finish, greatest(0, least(words, floor({m.BUDGET}e0 * (SELECT sum(size) FROM sized)) - earlier)) AS sent FROM served),
taken AS (SELECT doc_id, CAST(sum(sent) AS BIGINT) AS taken, min(finish) AS first_finish FROM cut WHERE sent > 0 GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_finish FROM queued LEFT JOIN taken USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express on whole tables. It can't express the
    others: op1 (patterns with a look at what stands beside), op2 and op9 (tokenizers), op3 (a
    parser), op7 (a window per byte takes too long) and op10 (a trained network); tests hold
    these against brute force."""
    return {"op4_decontamination": _contamination_sql(), "op5_minhash_dedup": _near_duplicates_sql(), "op6_quality_rules": _quality_sql(), "op8_mixing": _mixing_sql()}
