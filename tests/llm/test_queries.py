"""Operators and registered queries on Spark against brute force: nulls, ties, repeats, empty tables, clashing names."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from mixloom.llm import bpe, chat, components, decontaminate, html, jaccard, language, quality, registry  # noqa: E402
from mixloom.llm import tokens, toxicity, urls  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS)
ODD = [None, "", " \n\t", "x", "é 😀", LONG, LONG, " ".join(["again and"] * 300), "a\x00b"]
WORD_FILE, BYTE_FILE = (public_tokenizers.path(n) for n in (registry.WORD_TOKENIZER, registry.BYTE_TOKENIZER))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, f"own {i}", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, score int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


ADDING = {
    "quality": lambda df: quality.quality(df),
    "tokens": lambda df: tokens.token_counts(df, BYTE_FILE),
    "digests": lambda df: bpe.digests(df, WORD_FILE),
    "ids": lambda df: bpe.encode_and_decode(df, WORD_FILE),
    "language": lambda df: language.identify(df, None),
    "toxicity": lambda df: toxicity.score(df, toxicity.ToxicityModel({"x": 3.0}, toxicity.DEFAULT_CURVE)),
    "urls": lambda df: urls.url_verdicts(df, "text"),
    "html": lambda df: html.extract(df.withColumnRenamed("text", "html")),
}


@pytest.mark.parametrize("name", sorted(ADDING))
def test_rows_stay_whatever_they_hold(odd, empty, name):
    made = ADDING[name](odd)
    assert len(made.columns) == len(set(made.columns))
    assert sorted(str(r["doc_id"]) for r in made.collect()) == sorted(str(r["doc_id"]) for r in odd.collect())
    kept = [c for c in odd.columns if dict(made.dtypes).get(c) == dict(odd.dtypes)[c] and c != "text"]
    assert "doc_id" in kept
    none = ADDING[name](empty)
    assert none.count() == 0 and none.columns == ADDING[name](empty.limit(0)).columns


FILTERS = {
    "quality": lambda spark, df: quality.passing(df),
    "language": lambda spark, df: language.recognised(df, None),
    "jaccard": lambda spark, df: jaccard.distinct_documents(df),
    "benchmark": lambda spark, df: decontaminate.clean_documents(
        df, spark.createDataFrame([(1, LONG), (2, None), (3, "")], "item_id bigint, text string")
    ),
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_keep_columns(spark, odd, empty, name):
    kept = FILTERS[name](spark, odd)
    assert kept.dtypes == odd.dtypes
    found = sorted(r["score"] for r in kept.collect())
    assert found == {"quality": [5, 6], "language": [], "jaccard": [0, 1, 2, 3, 4, 5, 7, 8], "benchmark": [0, 1, 2, 3, 4, 7, 8]}[name]
    assert FILTERS[name](spark, empty).count() == 0


def test_quality_query(spark, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    found = rows_of(registry.op5_quality_rules(spark, SF))
    assert set(found) == set(texts)
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (found[i]["n_words"], found[i]["word_chars"]) == (len(words), sum(map(len, words)))


def test_bpe_query(spark, documents):
    library = Tokenizer.from_file(WORD_FILE)
    found = rows_of(registry.op2_bpe(spark, SF))
    for r in documents.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        got = found[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == sha(b"".join(i.to_bytes(4, "little") for i in ids))
        assert got["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_token_count_query(spark, documents):
    library = Tokenizer.from_file(BYTE_FILE)
    found = rows_of(registry.op8_token_counts(spark, SF))
    for r in documents.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        got = found[r["doc_id"]]
        assert (got["n_bytes"], got["n_tokens"], got["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_language_query(spark, documents):
    found = rows_of(registry.op3_language_id(spark, SF))
    langs = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [i for i, r in found.items() if r["held_out"]]
    assert sum(found[i]["lang_pred"] == langs[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_ignores_held_out_labels(spark, documents):
    """Labels of held-out rows, sources and ids change nothing."""
    changed = documents.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    models = [language.fit(d.where(~language.held_out())) for d in (documents, changed)]
    assert models[0].families == models[1].families
    assert (models[0].between[1] == models[1].between[1]).all()


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    filler = ["some words of quite ordinary kind", "nothing to see in this line", "weather and trains and bread"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = f"{filler[i % 3]} number n{i} {filler[(i + 1) % 3]} v{i * 7 % 101}".split()
        if toxic:
            for k, term in enumerate(("blarg", "zonkface") if i % 8 else ("blarg", "idiot")):
                words.insert((i * 3 + 5 * k) % len(words), term)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels + [(9999, 1), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks.where(~toxicity.held_out()))
    assert {"blarg", "zonkface"} <= set(model.lexicon)
    found = rows_of(toxicity.score(docs, model))
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(found[i]["predicted"] == dict(labels)[i] for i in held) >= 0.97 * len(held)
    untaught = toxicity.fit(docs, marks.limit(0))
    assert untaught.curve == toxicity.DEFAULT_CURVE


def test_toxicity_query(spark):
    found = rows_of(registry.op6_toxicity(spark, SF))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found.values())


def plain_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r)):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        conv: (
            len(turns),
            sha("".join(f"{r}\n{t}\n" for r, t in turns)),
            sum(len(t) for r, t in turns if r == "assistant"),
            sha("".join(t for r, t in turns if r == "assistant")),
            sum(len(f"<|turn|>{chat.escape_role(r)}\n{chat.escape(t)}<|end|>\n") for r, t in turns),
        )
        for conv, turns in out.items()
    }


def test_chat_against_brute_force(spark):
    said = ["hi", None, "", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nfake", "日本 <\\|end|>", "x" * 70_000]
    rows = [(c, t, role, said[(c + t) % 7]) for c in range(9) for t, role in enumerate(["system", "user", "assistant"] * 3)]
    rows += [(None, 0, "user", "a"), (None, None, None, "b"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (4, 2, "assistant\n", "role")]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    found = chat.chat_digests(chat.format_chat(turns)).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == plain_chat(rows)
    assert len(found) == len(plain_chat(rows))
    assert chat.format_chat(turns.limit(0)).count() == 0
    assert chat.chat_digests(chat.format_chat(turns.limit(0))).count() == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    found = {r["conv_id"]: tuple(r)[1:] for r in registry.op4_chat_formatting(spark, SF).collect()}
    assert found == plain_chat(rows)
    assert found[-1][3] == sha("</s>[INST] ok [/INST]")


def test_url_and_html_queries(spark):
    pages = rows_of(spark.read.parquet(f"{SF}/pages.parquet"), "page_id")
    judged, texts = rows_of(registry.op7_url_filter(spark, SF), "page_id"), rows_of(registry.op10_html_extraction(spark, SF), "page_id")
    assert set(judged) == set(texts) == set(pages)
    for i, page in pages.items():
        assert judged[i]["host"] == page["url"].split("://")[1].split("/")[0].lower()
        assert texts[i]["text"] == html.main_text(page["html"]) and texts[i]["n_chars"] == len(texts[i]["text"])
        for line in texts[i]["text"].split("\n"):
            assert line == " ".join(line.split())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103), (200, 200), (None, 5), (7, 7), (300, 301), (301, 300)]
    found = rows_of(components.components(spark.createDataFrame(edges, "a bigint, b bigint")), "node")
    assert {n: r["component"] for n, r in found.items()} == {
        **dict.fromkeys(range(61), 0), **dict.fromkeys((100, 103, 105), 100), **dict.fromkeys((300, 301), 300)
    }
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_groups(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])

    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for n, (a, s) in enumerate(sets):
        for b, u in sets[:n]:
            if s and u and 100 * len(s & u) >= 85 * len(s | u):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in sets}


def near_copies(seed, count):
    import random

    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        base = [rng.choice(WORDS) for _ in range(rng.randint(4, 150))]
        for _ in range(count):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 50)}"
            texts.append(" ".join(copy[: rng.choice([None, -1, -3])]))
    return texts + ["", None, "one", "ONE", "two words", "a b c", "A B c", "a b c d"] + texts[:9]


@pytest.mark.parametrize("seed,apart", [(1, False), (2, True), (3, True)])
def test_jaccard_groups_against_brute_force(spark, monkeypatch, seed, apart):
    """Small blocks; once whole clusters in tiles, else every signature on its own behind sketches."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 6)
    if apart:
        chosen = jaccard.clusters
        monkeypatch.setattr(jaccard, "clusters", lambda open_, sizes: chosen(open_, sizes, dense=0.0))
    rows = list(enumerate(near_copies(seed, 14)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = jaccard.jaccard_groups(docs)
    assert {tuple(r) for r in found.collect()} == plain_groups(rows)
    assert found.count() == len(rows)


def test_every_set_is_in_a_tile_once(spark, monkeypatch):
    """Copies of a set that pass the filter of wanted rows do not fill the tiles."""
    seen, tiled = [], jaccard.tiled

    def watched(members, sets, percent):
        seen.append(sets.groupBy("node").count().agg(F.max("count"), F.count("*")).first())
        return tiled(members, sets, percent)

    monkeypatch.setattr(jaccard, "tiled", watched)
    texts = dict(enumerate(near_copies(5, 10)))
    rows = [(i, t) for i, t in texts.items() for _ in range(12)]
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert seen[0][0] == 1 and seen[0][1] > 20
    assert {tuple(r) for r in found.collect()} == plain_groups(list(texts.items()))


def test_jaccard_of_repeated_and_missing_ids(spark):
    rows = [(1, LONG), (1, LONG + " more"), (2, LONG), (None, LONG), (5, None)]
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r[0]), r[2]) for r in found) == [("1", 1), ("1", 1), ("2", 1), ("5", 5), ("None", None)]


def test_leaks_against_brute_force(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    squeeze = lambda t: " " + " ".join(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) + " "
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    whole = {(d["doc_id"], i["item_id"]) for d in docs for i in items if squeeze(i["text"]) in squeeze(d["text"])}
    found = registry.op1_decontamination(spark, SF).collect()
    assert whole <= {(r["doc_id"], r["item_id"]) for r in found}
    assert all(r["similarity"] >= decontaminate.SIMILARITY for r in found)


def test_leaks_in_parts_are_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    once = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 3000)
    assert len(decontaminate.benchmark_parts(items)) > 2
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == once
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_leaks_keep_the_type_of_ids_and_bound_repeated_items(spark, monkeypatch):
    long = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([("d1", long), ("d2", "yes"), ("d3", None)], "doc_id string, text string")
    items = [(f"i{n}", long) for n in range(40)] + [("i0", long)] * 3 + [("short", "Yes"), (None, None), ("none", "")]
    items = spark.createDataFrame(items, "item_id string, text string")
    wanted = sorted([("d1", f"i{n}") for n in range(40)] + [("d2", "short")])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()) == wanted
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1000)
    parts = decontaminate.benchmark_parts(items)
    # Copies of one text are dealt over the parts like others.
    assert max(p.count() for p in parts) < 20 and sum(p.count() for p in parts) == 41
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()) == wanted
    assert [r["doc_id"] for r in decontaminate.clean_documents(docs, items).collect()] == ["d3"]


def test_copies_take_no_room_in_the_language_sample(spark, monkeypatch):
    copies = [("en", "the same words again and again")] * 500
    others = [("en", f"the cat and dog number {i} sat there") for i in range(60)] + [("de", f"der hund und die katze {i} sind da") for i in range(60)]
    docs = spark.createDataFrame(copies + others, "lang string, text string").repartition(4)
    seen = []
    monkeypatch.setattr(language, "train", lambda x, names, families: seen.append(list(names)))
    language.fit(docs, rows=1000)
    assert sorted(seen[0]) == ["de"] * 60 + ["en"] * 61
    language.fit(docs, rows=20)
    assert all(8 <= seen[1].count(name) <= 40 for name in ("en", "de"))


def test_repeated_ids_take_no_room_in_the_toxic_sample(spark):
    rows = [(1, f"text {n % 7}") for n in range(300)] + [(2, "b"), (3, None), (None, "c"), (4, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, None)], "doc_id bigint, toxic int")
    found = toxicity.labelled_sample(docs, labels).collect()
    assert sorted((r["doc_id"], r["text"], r["toxic"]) for r in found) == [(1, "text 0", 1), (2, "b", 0), (3, None, 0)]


def test_pipeline_against_plain_stages(spark, documents):
    docs = [r for r in documents.collect()]
    good = {r["doc_id"] for r in quality.quality(documents).where("kept").collect()}
    docs = [r for r in docs if r["doc_id"] in good]
    kept = documents.where(F.col("doc_id").isin(list(good)))
    model = language.fit(kept.where(~language.held_out()))
    named = rows_of(language.identify(kept, model))
    docs = [r for r in docs if named[r["doc_id"]]["lang_pred"] != "und" and named[r["doc_id"]]["score"] >= language.LEAST_SCORE]
    groups = {d: g for d, _, g in plain_groups([(r["doc_id"], r["text"]) for r in docs])}
    docs = [r for r in docs if groups[r["doc_id"]] == r["doc_id"]]
    leaking = {r["doc_id"] for r in decontaminate.leaks(documents, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    docs = [r for r in docs if r["doc_id"] not in leaking]
    library = Tokenizer.from_file(WORD_FILE)
    found = rows_of(corpus_pipeline.run(spark, SF))
    assert set(found) == {r["doc_id"] for r in docs} and len(docs) < 200
    for r in docs:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert found[r["doc_id"]]["ids"] == ids and found[r["doc_id"]]["n_tokens"] == len(ids)
        assert found[r["doc_id"]]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_stages_return_documents(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents.limit(0), SF).dtypes == documents.dtypes
