"""Each query's operator against brute force, on the test tables and on awkward rows."""

import time

import brute
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchment_engine.llm import decontamination, language_id, licenses, minhash_dedup, mixing, pii, quality, queries, suffix_dedup, token_counts, token_store

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that operators use themselves.
        T.StructField("node", T.LongType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("component", T.StringType()),
    ]
)


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


def edge_rows():
    long = words(1, 6000)
    base = words(5, 300)
    near = base.split()
    near[50] = "changed"
    texts = [
        None,
        "",
        " \n\t ",
        "one",
        "one",
        "Two words",
        "two WORDS",
        base,
        base,
        " ".join(near),
        long,
        long + " tail",
        "x" * 3000,
        "ab" * 400 + " " + "ab" * 400,
        "Write to a.b+c@mail.example.com, +1 (555) 123-4567 or 4111 1111 1111 1111 from 10.0.0.255 and 10.0.0.256",
        "IBAN DE89370400440532013000 of my bank account, and x@y.z_d@e.fg",
        "1.2.3.4.5.6.7.8 5 5 5 -- 1234567890123 é@a.b \U0001f600 0@b.c.d",
        "Released under the MIT License. SPDX-License-Identifier: (MIT OR GPL-2.0) AND BSD-3-Clause WITH x",
        "mit license mit license General Public License",
        "a\nb\na\nb\na\n" * 30,
        "%%% ### $$$ " * 40,
        "Straße Ünïcödé ÀÉÎ don't İstanbul ΣΣ 中文 3.14 <|endoftext|> áb",
    ]
    rows = [(i, t, ("en", None, "de")[i % 3], ("a", None, "b", "é")[i % 4], i, "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[7], rows[0]]  # repeated rows


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def check(df, columns, expected):
    rows = df.collect()
    for r in rows:
        assert [r[c] for c in columns] == expected[r["doc_id"]], r["doc_id"]
    return rows


@pytest.fixture(params=["edge", "docs"])
def table(request):
    return request.getfixturevalue(request.param)


def test_pii(table):
    got = pii.pii_report(pii.find_pii(table))
    want = {d: brute.pii(t)[0] for d, t in pairs(table)}
    rows = check(got, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"], want)
    assert len(rows) == table.count()
    for r in rows:
        base = brute.pii(dict(pairs(table))[r["doc_id"]])[1]
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])


def test_pii_validators(spark):
    good, bad = "Konto DE89370400440532013000", "Konto DE89370400440532013001"
    got = {r["doc_id"]: r for r in pii.pii_report(pii.find_pii(spark.createDataFrame([(1, good), (2, bad), (3, "ssn 123-45-6789"), (4, "no. 123-45-6789")], "doc_id long, text string"))).collect()}
    assert (got[1]["n_iban"], got[2]["n_iban"], got[3]["n_ssn"], got[4]["n_ssn"]) == (1, 0, 1, 0)


@pytest.mark.parametrize("piece", ["a@b.cd ", "1.", "1.2.3.4 ", "+123456789 ", "4111 1111 1111 1111;"])
def test_pii_many_matches(spark, piece):
    """Time grows as the matches: a text of 100,000 addresses takes seconds, not their square."""
    text = piece * 100_000
    began = time.time()
    r = pii.pii_report(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert time.time() - began < 60
    want = brute.pii(text)[0]
    assert [r[c] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")] == want


def test_token_counts(spark, table):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks, known = brute.bpe_ranks(path), {}
    sizes = [brute.bpe_count(t, ranks, pattern, known) for _, t in pairs(table)]
    report = token_counts.suffix_report(token_counts.length_histogram(token_counts.encoded_lengths(table, path, pattern)))
    for r in report.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == sizes.count(n)
        assert r["docs_at_least"] == sum(s >= n for s in sizes)
        assert r["tokens_at_least"] == sum(s for s in sizes if s >= n)
        assert r["truncated_tokens"] == sum(min(s, n) for s in sizes)
        assert r["cum_docs"] == sum(s <= n for s in sizes)
    assert token_counts.truncated_total(report, 10).first()["tokens"] == sum(min(s, 10) for s in sizes)
    assert token_counts.quantile(report, 0.5).first()["n_tokens"] == sorted(sizes)[-(-len(sizes) // 2) - 1]


def test_licenses(table):
    want = {d: brute.licenses(t) for d, t in pairs(table)}
    check(licenses.license_report(licenses.scan_licenses(table)), ["n_words", "n_base", "first_word", "last_word", "base_labels"], want)


@pytest.mark.parametrize(
    ("text", "met"),
    [("MIT", True), ("GPL-3.0", False), ("MIT OR GPL-3.0", True), ("MIT AND GPL-3.0", False), ("(MIT)", True), ("GPL-3.0 AND ISC OR MIT", True), ("Apache-2.0 WITH LLVM-exception", True), ("MIT OR", None), ("(MIT", None), ("MIT ISC", None), ("", None), ("() MIT", None), ("(MIT OR ISC) WITH x", None)],
)
def test_license_expressions(text, met):
    rpn = licenses.parse_expression(text)
    assert (licenses.evaluate(rpn, licenses.PERMISSIVE) if rpn else None) is met


def test_license_identifiers(spark):
    """Unknown identifiers are reported and weigh nothing; tags are found where they stand."""
    texts = ["SPDX-License-Identifier: banana", "x SPDX-License-Identifier: MIT OR banana\nmore", "// spdx-license-identifier :\tGPL-2.0-only */", "SPDX License Identifier: MIT", "SPDX-License-Identifier MIT", "éé SPDX-License-Identifier: MIT\r\nSPDX-License-Identifier: ISC"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["unknown_ids"], r["score"], r["n_tags"], r["permitted"]) for r in licenses.license_report(licenses.scan_licenses(docs)).collect()}
    assert got == {0: ("", "banana", 0.0, 1, False), 1: ("mit", "banana", 1.0, 1, True), 2: ("gpl-2.0-only", "", 1.0, 1, False), 3: ("", "", 0.0, 0, None), 4: ("", "", 0.0, 0, None), 5: ("isc,mit", "", 1.0, 2, True)}


def test_decontamination(spark, table):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    more = spark.createDataFrame([(900, "two words"), (901, words(1, 40)), (902, None), (903, ""), (900, "two words")], "item_id long, text string")
    benchmark = benchmark.select("item_id", "text").unionByName(more)
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    want = brute.contamination(pairs(table), items)
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = check(decontamination.contamination_report(decontamination.find_contamination(table, benchmark)), columns, want)
    assert len(rows) == table.count() and any(r["contaminated"] for r in rows)
    check(decontamination.contamination_report(decontamination.find_contamination(table, benchmark, block_chars=2000)), columns, want)


def test_decontamination_proximity(spark):
    """All terms within 20 words, whatever the splits of files, partitions and blocks."""
    texts = ["alpha beta gamma", "gamma then beta and alpha", "alpha " + "x " * 60 + "beta gamma", "alpha " + "x " * 17 + "beta gamma", "alpha " + "x " * 18 + "beta gamma", "beta " * 9 + "x " * 10 + "gamma " * 3 + "x " * 15 + "alpha"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma"), (8, "beta gamma")], "item_id long, text string")
    want = {1: (["7", "8"], ["7", "8"]), 2: ([], ["7", "8"]), 3: (["8"], ["8"]), 4: (["8"], ["7", "8"]), 5: (["8"], ["8"]), 6: ([], ["8"])}
    for parts, chars in ((1, 1000), (3, 1000), (6, 1)):
        found = decontamination.find_contamination(docs.repartition(parts), items, block_chars=chars)
        assert {r["doc_id"]: (r["items"], r["near_items"]) for r in found.collect()} == want


def test_decontamination_stored_index(spark, docs, tmp_path):
    """One index, in small segments, for several benchmarks in several blocks."""
    index = decontamination.build_index(docs, f"file://{tmp_path}/index", segment_words=3000)
    assert index.count() > 5
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for part in (items, items[:1], items[3:9], []):
        table = spark.createDataFrame(part, "item_id long, text string")
        found = decontamination.search_index(index, table, block_chars=3000)
        check(decontamination.contamination_report(found), columns, brute.contamination(pairs(docs), part))


def test_decontamination_rows(spark):
    """Null and repeated ids are rows of their own."""
    docs = spark.createDataFrame([(None, "a b c"), (None, "x"), (1, "a b c"), (1, "a b c"), (1, None)], "doc_id long, text string")
    found = decontamination.find_contamination(docs, spark.createDataFrame([(5, "B c"), (None, "a")], "item_id long, text string"))
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in found.collect())
    hit = [(0, 3)]
    assert got == [("1", 0, [], []), ("1", 3, hit, ["5"]), ("1", 3, hit, ["5"]), ("None", 1, [], []), ("None", 3, hit, ["5"])]


def test_near_duplicates(table):
    want = brute.near_duplicates(pairs(table))
    rows = check(minhash_dedup.near_duplicates(table), ["n_shingles", "component_id", "kept"], want)
    assert len(rows) == table.count()


def test_near_duplicates_without_ids(spark):
    text = words(9, 80)
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([(None, text), (4, text), (None, words(3, 50)), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (-1, -1, True), (-1, 4, False), (4, 4, True)]


def test_near_duplicates_refuses_other_ids(spark):
    with pytest.raises(TypeError):
        minhash_dedup.near_duplicates(spark.createDataFrame([("a", "x y")], "doc_id string, text string"))
    with pytest.raises(Exception, match="beyond"):
        minhash_dedup.near_duplicates(spark.createDataFrame([(1 << 62, "x y")], "doc_id long, text string")).collect()


@pytest.mark.parametrize("blocks", [(16_384, 128, 8), (200, 8, 2)])
def test_near_duplicates_in_a_loose_group(spark, blocks, monkeypatch):
    """Many texts around one, some linked with others but not with the first; also with small
    blocks and tiles."""
    import random

    for name, size in zip(("BLOCK_SHINGLES", "BLOCK_NODES", "TILE"), blocks, strict=True):
        monkeypatch.setattr(minhash_dedup, name, size)

    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in r.sample(range(60), r.choice((2, 4, 6))):
            own[k] = f"c{r.randrange(12)}"
        rows.append((i + 10, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(minhash_dedup.near_duplicates(df), ["n_shingles", "component_id", "kept"], brute.near_duplicates(rows))


def test_quality(table):
    want = {d: brute.quality(t) for d, t in pairs(table)}
    rows = check(quality.assess(table), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], want)
    assert len(rows) == table.count() and not any(r["base_failed"] and r["kept"] for r in rows)


def test_quality_groups_decide(spark):
    """The same ratios pass in a group of wide spread and fail in one of narrow spread; both
    fences can be tighter and looser than any one cutoff."""
    def text(k, marks):
        body = [f"{'abcdefgh'[(k + i) % 8]}{(k * 31 + i * 7) % 90 + 10}x" for i in range(60)]
        return " ".join(body[: 60 - marks] + [f"#%&{i}" for i in range(10, 10 + marks)])

    rows = [(k, text(k, 2 * (k % 15)), "en", "code") for k in range(600)] + [(1000 + k, text(k, 0), "en", "news") for k in range(600)]
    rows += [(2000, text(1, 28), "en", "code"), (2001, text(1, 28), "en", "news"), (2002, text(1, 1), "en", "news"), (2003, text(3, 0), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.assess(docs, keep=["doc_id", "lang", "source"]).collect()}
    assert not any(got[d]["base_failed"] for d in (2000, 2001, 2002, 2003))
    assert [got[d]["kept"] for d in (2000, 2001, 2002, 2003)] == [True, False, True, True]
    assert sum(got[d]["kept"] for d in range(600)) == 600
    at = {r["source"]: r for r in quality.fences(quality.features(docs)).collect()}  # not staged
    assert at["news"]["symbol_ratio_high"] < 0.3 < at["code"]["symbol_ratio_high"] and at["code"]["n_group"] == 601


def test_quality_clashing_columns(spark):
    rows = [(1, "a b", "en", "s", 5, "x", 7), (2, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, __row string, kept int")
    out = quality.assess(docs, keep=["doc_id", "lang", "source", "n_words"])
    assert {"lang", "source", "n_words_in", "n_words", "kept"} <= set(out.columns) and out.count() == 2
    assert quality.keep_good(docs.unionByName(docs)).count() == 0
    good = docs.withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("word"), i.cast("string")))))
    assert sorted(map(tuple, quality.keep_good(good).collect()), key=str) == sorted(map(tuple, good.collect()), key=str)


def test_quality_keeps_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.assess(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    clean, junk = [r for r in judged if r["quality"] == 1], [r for r in judged if r["quality"] == 0]
    assert all(r["kept"] for r in clean) and sum(not r["kept"] for r in junk) >= 0.9 * len(junk)


def repeats_of(rows):
    return sorted(([r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")] for r in rows), key=str)


def passages_of(rows):
    return sorted((r["doc_id"], r["n_words"], r["n_passage_words"], r["n_passages"]) for r in rows)


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_repeats(table, group):
    """Also with a gram's contexts in groups of one."""
    rows = suffix_dedup.remove_repeats(table, group=group).collect()
    assert repeats_of(rows) == sorted(map(list, brute.repeats(pairs(table))), key=str)
    assert passages_of(rows) == brute.passages(pairs(table))


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_passages(spark, group):
    """Passages of 51 words are caught whatever their bytes and neighbours, shorter ones and
    those of one document alone aren't."""
    a, b, c = (words(k, 51) for k in (11, 12, 13))
    rows = [(1, f"{words(20, 9)} {a} {words(21, 30)}"), (2, f"{words(22, 70)}  {a}\n"), (3, f"{b} x {b}"), (4, words(23, 60)), (5, f"y {c.rsplit(' ', 1)[0]} z"), (6, c)]
    rows += [(100 + k, f"{words(300 + k, 20)} {a} {words(400 + k, 20)}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(docs, group=group).collect()
    assert passages_of(got) == brute.passages(rows)
    assert {r["doc_id"] for r in got if r["n_passages"]} == {1, 2, *range(100, 130)}
    assert repeats_of(got) == sorted(map(list, brute.repeats(rows)), key=str)


def test_contexts_of_many_texts():
    """Texts taken together have the contexts that each has alone, the windows of which are the
    text's, each once, with the anchor that its letters tell; and cost less than one by one."""
    import random

    import numpy as np

    r = random.Random(9)
    texts = [bytes(r.choices(b"ab c", k=r.choice((0, 5, 39, 40, 41, 300)))) for _ in range(400)] + [b"a" * 500, b"ab" * 300]
    letters = [np.frombuffer(t, np.uint8) for t in texts]
    for size, gram in ((40, 16), (40, 39), (40, 1)):
        n, found = suffix_dedup._contexts_of(letters, size, gram, suffix_dedup.BYTES)
        stops = np.cumsum(n)
        seen = {}
        for t, a, b in zip(texts, stops - n, stops, strict=True):
            (k,), alone = suffix_dedup._contexts_of([np.frombuffer(t, np.uint8)], size, gram, suffix_dedup.BYTES)
            assert k == b - a and all(np.array_equal(x, y[a:b]) for x, y in zip(alone, found, strict=True))
            first, last, g = (x[a:b].tolist() for x in found[:3])
            assert [i for x, y in zip(first, last, strict=True) for i in range(x, y + 1)] == list(range(len(t) - size + 1))
            for x, y, h in zip(first, last, g, strict=True):
                for i in range(x, y + 1):
                    assert seen.setdefault(t[i : i + size], h) == h
        assert any(v != next(iter(seen.values())) for v in seen.values())
    many = [np.frombuffer(bytes(r.choices(b"abcdefgh ", k=600)), np.uint8) for _ in range(1000)]
    taken = []
    for groups in ([many], [[x] for x in many]):
        began = time.process_time()
        for some in groups:
            suffix_dedup._contexts_of(some, suffix_dedup.SIZE, suffix_dedup.GRAM, suffix_dedup.BYTES)
        taken.append(time.process_time() - began)
    assert taken[0] < 0.7 * taken[1]


def test_suffix_ranks():
    import random

    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        s = [r.randint(1, r.choice((1, 2, 5))) for _ in range(r.randint(0, 50))]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert np.argsort(suffix_dedup.suffix_ranks(np.array(s, int))).tolist() == order


def test_mixing(table):
    rows = mixing.mix(table).collect()
    source = {r["doc_id"]: r["source"] for r in table.select("doc_id", "source").collect()}
    sizes, targets = brute.mix_targets([(r["source"], r["text"]) for r in table.select("source", "text").collect()])
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(rows) == table.count()
    assert all(abs(taken[s] - targets[s]) <= mixing.PACKET for s in sizes)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(table.repartition(5)).collect()), key=str)


def test_mixing_blocks(spark, docs, monkeypatch):
    """The number of blocks follows the rows and has no say in the result."""
    assert [mixing.digits_for(n) for n in (0, 10**6, 10**8, 10**10)] == [3, 3, 4, 5]
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "LEAST_DIGITS", 1)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == want


def test_token_store(spark, table, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, file = f"file://{tmp_path}/store", public_tokenizers.path(queries.TOKENIZER)
    token_store.write_store(table, path, file, queries.VOCABULARY, queries.END_ID)
    rows = token_store.read_documents(spark, path, queries.VOCABULARY).orderBy("start").collect()
    library, at = Tokenizer.from_file(file), 0
    for (doc, text), r in zip(sorted(pairs(table), key=lambda x: (x[0], x[1] or "")), rows, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, queries.END_ID]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, at, len(ids))
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
        at += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_token_store_notices_changes(spark, docs, tmp_path):
    import public_tokenizers

    path, other = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    file = public_tokenizers.path(queries.TOKENIZER)
    token_store.write_store(docs.limit(20), path, file, queries.VOCABULARY, queries.END_ID)
    token_store.write_store(docs.where("doc_id > 50").limit(20), other, file, queries.VOCABULARY, queries.END_ID)
    spark.read.parquet(f"{other}/recipes").write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(Exception, match="doesn't match"):
        token_store.read_documents(spark, path, queries.VOCABULARY).collect()


def test_language_network():
    """The forward pass against plain loops, the gradients against differences."""
    import numpy as np

    r = np.random.default_rng(4)
    net = language_id.start(["a", "b", "c"])
    for name in ("embedding", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = [w.astype(np.float64) for w in net.filters]
    net.bias += r.normal(0, 0.1, net.bias.shape)
    x, y, weight = r.integers(0, 256, (4, 12)).astype(np.uint8), np.array([0, 1, 2, 1]), np.array([1.0, 0.5, 2.0, 1.5])
    h, _ = language_id.features(net, x)
    for row in range(len(x)):
        want = []
        for w in net.filters:
            for f in range(w.shape[2]):
                sums = [sum(net.embedding[x[row, p + j], d] * w[j, d, f] for j in range(len(w)) for d in range(w.shape[1])) for p in range(x.shape[1] - len(w) + 1)]
                want.append(max(0.0, max(sums) + net.bias[len(want)]))
        assert np.allclose(h[row], want)
    for param, grad in zip([net.embedding, *net.filters, net.bias, net.out, net.out_bias], language_id.gradients(net, x, y, weight), strict=True):
        for i in r.choice(param.size, min(40, param.size), replace=False):
            at = np.unravel_index(i, param.shape)
            old, step = param[at], 1e-6
            param[at] = old + step
            up = language_id.loss(net, x, y, weight)
            param[at] = old - step
            down = language_id.loss(net, x, y, weight)
            param[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-5


def test_language_sample(spark):
    """Every label is learned, however many there are; copies and null ids don't flood it."""
    rows = [(k, f"text number {k} in words", f"l{k % 50}") for k in range(1500)]
    rows += [(None, "the same words again", "l1")] * 500 + [(5000 + k, "123", "digits") for k in range(8)] + [(7, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.training_sample(docs, per_language=10, most=200)
    langs = {lang for _, lang in got}
    assert langs == {f"l{k}" for k in range(50)} and len(got) <= 450
    assert got == language_id.training_sample(docs.repartition(7), per_language=10, most=200)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.train(language_id.training_sample(docs))
    rows = language_id.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == language_id.crc_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_id_without_letters(spark, edge):
    net = language_id.train([(b"the and of with", "en"), ("der die und für".encode(), "de")])
    got = {r["doc_id"]: r for r in language_id.identify(edge, net).collect()}
    assert all(got[d]["lang_pred"] == "und" for d in (0, 1, 2, 20)) and got[5]["lang_pred"] in ("en", "de")
    assert {r["lang_pred"] for r in language_id.identify(edge, None).collect()} == {"und"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert pii.pii_report(pii.find_pii(empty)).count() == 0
    assert token_counts.suffix_report(token_counts.length_histogram(token_counts.encoded_lengths(empty, path, pattern))).count() == 0
    assert licenses.license_report(licenses.scan_licenses(empty)).count() == 0
    assert decontamination.find_contamination(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert quality.assess(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert language_id.training_sample(empty) == []


def test_empty_store(spark, tmp_path):
    import public_tokenizers

    path = f"file://{tmp_path}/empty"
    token_store.write_store(spark.createDataFrame([], SCHEMA), path, public_tokenizers.path(queries.TOKENIZER), queries.VOCABULARY, queries.END_ID)
    assert token_store.read_documents(spark, path, queries.VOCABULARY).count() == 0


def test_megabyte_texts(spark, tmp_path):
    """Two texts of 1.5 MB that differ in one word, and a short one, through all operators."""
    import public_tokenizers
    from tokenizers import Tokenizer

    def word(k):
        out = ""
        for _ in range(5):
            k, r = divmod(k, 18)
            out += "bcdfghjklmnpqrstvw"[r] + "aeiou"[(k + r) % 5]
        return out[:-2] if k % 3 else out

    body = [word(k * 7919 % 1_800_000) for k in range(160_000)]
    body[150_000:150_000] = "Mail me@some.example.org, released under the MIT License.".split()
    other = list(body)
    other[70_000] = "changed"
    texts = {1: " ".join(body), 2: " ".join(other), 3: "a short text"}
    assert len(texts[1]) > 1_400_000
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in texts.items()], "doc_id long, text string, lang string, source string").repartition(2)
    rows = list(texts.items())
    check(pii.pii_report(pii.find_pii(docs)), ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"], {d: brute.pii(t)[0] for d, t in rows})
    check(licenses.license_report(licenses.scan_licenses(docs)), ["n_words", "n_base", "first_word", "last_word", "base_labels"], {d: brute.licenses(t) for d, t in rows})
    items = [(7, " ".join(body[155_000:155_030])), (8, "nothing of this kind")]
    found = decontamination.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    check(decontamination.contamination_report(found), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"], brute.contamination(rows, items))
    check(minhash_dedup.near_duplicates(docs), ["n_shingles", "component_id", "kept"], brute.near_duplicates(rows))
    check(quality.assess(docs), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], {d: brute.quality(t) for d, t in rows})
    a, b = texts[1], texts[2]
    ahead = next(i for i in range(len(a)) if a[i] != b[i])
    behind = next(i for i in range(len(a)) if a[-1 - i] != b[-1 - i])
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[d]["n_removed"] for d in (1, 2, 3)] == [ahead + behind, ahead + behind, 0] and got[1]["n_spans"] == 2
    assert [got[d]["n_passage_words"] for d in (1, 2, 3)] == [len(body) - 1, len(body) - 1, 0] and got[1]["n_passages"] == 2
    assert sum(r["size"] for r in mixing.mix(docs).collect()) == 2 * len(body) + 3
    path, file = f"file://{tmp_path}/store", public_tokenizers.path(queries.TOKENIZER)
    token_store.write_store(docs, path, file, queries.VOCABULARY, queries.END_ID)
    want = brute.store_rows(rows, Tokenizer.from_file(file), queries.END_ID)
    check(token_store.read_documents(spark, path, queries.VOCABULARY).withColumn("crc", F.crc32("ids")), ["start", "n_tokens", "crc"], want)
    net = language_id.train([(b"the and of with", "en"), ("der die und für".encode(), "de")])
    assert all(r["lang_pred"] in ("en", "de") for r in language_id.identify(docs, net).collect())
    ranks, known = brute.bpe_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), {}
    lengths = token_counts.encoded_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(r["n_tokens"] for r in lengths.collect()) == sorted(brute.bpe_count(t, ranks, public_tokenizers.PATTERN, known) for t in texts.values())
