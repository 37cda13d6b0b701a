"""Each stage of the pipeline on its own input, against brute force where there is one."""

from collections import Counter

import brute
import pytest

import corpus_pipeline
from catchment_engine.llm import mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    out = {"start": spark.read.parquet(f"{SF}/documents.parquet")}
    docs = out["start"]
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"file://{at}/{i}")
        docs = out[name] = spark.read.parquet(f"file://{at}/{i}")
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_return_documents(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(steps[n].columns == steps["start"].columns for n in names[:-1])


def test_quality(steps, spark):
    before, after = texts(steps["start"]), texts(steps["quality rules"])
    assert not any(brute.quality(t)[-1] for t in after.values())
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert all(d in after for d, t in before.items() if d in clean and not brute.quality(t)[-1])


def test_near_duplicates(steps):
    want = brute.near_duplicates(list(texts(steps["quality rules"]).items()))
    assert set(texts(steps["near duplicates"])) == {d for d, r in want.items() if r[2]}


def test_decontamination(steps, spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.contamination(list(texts(steps["near duplicates"]).items()), items)
    assert set(texts(steps["decontamination"])) == {d for d, r in want.items() if not r[4]}


def test_mixing(steps):
    rows = steps["decontamination"].collect()
    sizes, targets = brute.mix_targets([(r["source"], r["text"]) for r in rows])
    longest = {s: max(len(brute.SPACED.findall(r["text"])) for r in rows if r["source"] == s) for s in sizes}
    taken = dict.fromkeys(sizes, 0)
    for r in steps["mixing"].collect():
        taken[r["source"]] += len(brute.SPACED.findall(r["text"]))
    assert all(abs(taken[s] - targets[s]) <= longest[s] + 512 for s in sizes)
    assert max(r["count"] for r in steps["mixing"].groupBy("doc_id").count().collect()) <= 2


def test_token_store(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), 0, []
    for r in sorted(steps["mixing"].collect(), key=lambda r: (r["doc_id"], r["text"])):
        got = brute.store_rows([(r["doc_id"], r["text"])], library, queries.END_ID)[r["doc_id"]]
        want.append((r["doc_id"], at, got[1], got[2]))
        at += got[1]
    assert sorted(map(tuple, steps["token store"].collect())) == sorted(want)


def test_repeated_rows_lose_all_but_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    twice = docs.unionByName(docs)
    out = corpus_pipeline.near_duplicates(spark, twice, SF).collect()
    assert len(out) == len({r["doc_id"] for r in out})


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def prose(seed, n=60):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * seed) % 9973}" for i in range(n))


def test_near_duplicates_decides_each_row(spark):
    """Null ids of different texts, a group that has no id, and one id with two texts."""
    a, b, c, d, e, f = (prose(k) for k in range(1, 7))
    near = c + " tail"
    rows = [(None, a), (4, a), (None, b), (None, None), (None, c), (None, c), (None, near), (7, d), (7, e), (3, e + " end"), (9, f), (9, f), (None, None), (8, " ")]
    docs = rows_of(spark, [(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)]).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    loose = [x for x in got if x in [(None, c), (None, near)]]
    assert len(loose) == 1
    want = [(4, a), (None, b), (None, None), (None, None), (7, d), (3, e + " end"), (9, f), (8, " "), *loose]
    assert sorted(got, key=str) == sorted(want, key=str)
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(5), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in again), key=str) == sorted(got, key=str)


def test_mixing_decides_each_row(spark):
    """Many rows without an id, some of them equal: each stands as often as the mix takes it."""
    rows = [(None, prose(k, 40 + k % 7), "en", "a", k) for k in range(60)]
    rows += [(None, prose(99, 50), "en", "a", k % 2) for k in range(40)]
    rows += [(k, prose(200 + k, 45), "en", s, k) for k in range(40) for s in ("b", None)]
    rows += [(None, prose(300, 30), "de", "c", 1)] * 120
    docs = rows_of(spark, rows).repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["source"], r["doc_id"], r["text_hash"]] += int(r["taken"] / r["size"] + 0.5)
    out = corpus_pipeline.mixing(spark, docs, SF)
    got = Counter((r["source"], r["doc_id"], r["h"]) for r in out.select("source", "doc_id", mixing.text_hash(out["text"]).alias("h")).collect())
    assert got == +want
    # Both ends fall among rows without an id: of a among different rows, of c among equal ones.
    assert {1, 2} <= {n for (s, _, _), n in got.items() if s == "a"} and 120 < sum(n for (s, _, _), n in got.items() if s == "c") < 240


def test_stages_on_awkward_tables(spark):
    """Empty tables; null ids, texts, languages and sources; columns with the stages' own names."""
    own = ["__row", "__key", "__source", "__once", "__twice", "__copy", "__h1", "group", "kept", "n_words", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in own)
    rows = [(None if k % 3 == 0 else k, None if k == 4 else prose(k, 30 + k), None if k % 5 == 0 else "en", None if k % 4 == 0 else "s", k, *[f"{c}{k}" for c in own]) for k in range(1, 24)]
    rows += [rows[0], rows[1], (50, "", None, None, None, *[None] * len(own))]
    for table in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema).repartition(3)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, table, SF)
            got = [tuple(r) for r in out.collect()]
            if name == "token store":
                assert len(got) == table.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
                continue
            assert out.columns == table.columns and set(got) <= {tuple(r) for r in table.collect()}
            if table.head(1):
                assert len(got) >= 20
