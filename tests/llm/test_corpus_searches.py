"""SimHash groups, ranked search and the divergence audit against brute force and SQL on awkward tables."""

import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("public_tokenizers")

import check  # noqa: E402
from mixloom.llm import anchors, divergence, registry, search, statements, terms  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
ODD = [
    None, "", " \n\t", "x", "X", "x y", "é 😀 É", "a\x00b c1 d", "ab_cd;ef", LONG, LONG, "the cat the cat " * 40, "THE CAT",
    "ünder übung2 3x", "zz " * 300,
]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(ids, prints, radius=3):
    top = {i: i for i in range(len(ids))}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= radius:
            top[find(i)] = find(j)
    least = {}
    for i, own in enumerate(ids):
        least.setdefault(find(i), []).append(own)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_fingerprints_are_majorities_of_xxh64():
    texts = ODD + [" ".join(f"t{i * k % 11}" for i in range(k)) for k in range(40)]
    assert anchors.SimHash()(pa.array(texts, pa.string())).tolist() == [simhash(t) for t in texts]
    assert len(anchors.SimHash()(pa.array([], pa.string()))) == 0


def test_code_covers_every_half_and_reaches_every_anchor():
    halves = np.random.default_rng(5).integers(0, 2**32, 500, dtype=np.uint64)
    near = anchors.nearest_anchors(halves)
    assert (anchors.syndromes(near) == 0).all()
    assert max(bin(int(x)).count("1") for x in halves ^ near) == 1
    rows, found = anchors.all_anchors(halves)
    assert (anchors.syndromes(found) == 0).all() and len(set(zip(rows.tolist(), found.tolist()))) == len(rows)
    for half, own in ((int(halves[k]), set(found[rows == k].tolist())) for k in range(20)):
        ball = {half, *(half ^ 1 << i for i in range(32))}
        ball |= {half ^ 1 << i ^ 1 << j for i, j in itertools.combinations(range(32), 2)}
        values = np.array(sorted(ball), np.uint64)
        assert own == set(values[anchors.syndromes(values) == 0].tolist())


def test_links_hold_all_pairs_within_the_radius(spark):
    rng = random.Random(9)
    prints = {0}
    for _ in range(60):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(8):
            near = centre
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                near ^= 1 << bit
            prints.add(near)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print bigint").repartition(5)
    for radius in (0, 2, 3):
        found = {(r["a"], r["b"]) for r in anchors.links(frame, radius).collect()}
        pairs = itertools.combinations(sorted(signed), 2)
        assert found == {(a, b) for a, b in pairs if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
    with pytest.raises(ValueError):
        anchors.links(frame, 4)


@pytest.mark.parametrize("table", ["given", "odd"])
def test_simhash_groups(spark, table):
    if table == "given":
        made = registry.op11_simhash_dedup(spark, SF)
        rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    else:
        rows = [(None if i == 4 else i // 2 if i < 4 else i, t) for i, t in enumerate(ODD)]
        frame = spark.createDataFrame([(*r, "p", 7) for r in rows], "doc_id bigint, text string, print string, component int")
        made = anchors.simhash_groups(frame.repartition(3))
    prints = [simhash(t) for _, t in rows]
    wanted = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, groups_of([r[0] for r in rows], prints))]
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, wanted))
    assert made.columns == ["doc_id", "fingerprint", "component_id"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n int")
    items = spark.createDataFrame([(1, "a b"), (2, None)], "item_id bigint, text string")
    assert anchors.simhash_groups(docs).count() == 0
    assert divergence.divergence(docs).count() == 0
    assert search.search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert search.search(some, items.where("item_id > 1")).count() == 0
    assert [tuple(r) for r in search.search(some, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_terms_are_the_runs_of_the_class():
    for ends, pattern in (
        (terms.NO_LETTER, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"),
        (terms.NO_LETTER_OR_DIGIT, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"),
    ):
        found = terms.counted(pa.array(ODD, pa.string()), ends)
        names = [t.decode() for t in found.terms.to_pylist()]
        got = {(r, names[t]): n for r, t, n in zip(found.row.tolist(), found.term.tolist(), found.times.tolist())}
        wanted = {}
        for row, text in enumerate(ODD):
            for term in re.findall(pattern, lowered(text)):
                wanted[row, term] = wanted.get((row, term), 0) + 1
        assert got == wanted


def by_sql(statement, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    result = con.execute(statement)
    columns = [d[0] for d in result.description]
    return check.bag(columns, result.fetchall())


def corpus(spark, rows, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ta", "Ko", "ü", "mi") for b in ("lon", "r", "vetß") for c in ("", "e", "antisti", "9")]
    made = []
    for i in range(rows):
        text = " ".join(rng.choice(words[: rng.choice((5, 20, 48))]) for _ in range(rng.choice((0, 1, 6, 40))))
        source = rng.choice([None, "", "a", "a", "a", "b", "ç"])
        made.append((None if i % 29 == 3 else i % 150, rng.choice([text, text, None]), rng.choice(["en", "en", "", None]), source))
    made += [(500 + i, t, "xx", f"s{i % 3}") for i, t in enumerate(ODD)]
    return spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string").repartition(4)


def test_search_is_exact_whatever_is_skipped(spark, monkeypatch):
    docs = corpus(spark, 400)
    monkeypatch.setattr(search, "BLOCK_BYTES", 400)
    texts = ["talon Kor ür mir mivetß9", "TA ko9 ü", None, "", "!!", "talon", "nothing here", " ".join(f"ta{c}" for c in "abc"), "x y é"]
    items = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "item_id bigint, text string, rank int")
    wanted = by_sql(statements.SEARCH, documents=docs, benchmark=items)
    for most in (4096, 3):
        monkeypatch.setattr(search, "PART_TERMS", most)
        made = search.search(docs.withColumn("score", docs.doc_id), items)
        assert check.bag(made.columns, made.collect()) == wanted


def test_search_scores_fewer_documents_with_pairs():
    rng = np.random.default_rng(2)
    docs, count = 900, 8
    here = rng.random((count, docs)) < 0.4
    here[4:] &= ~here[:4]  # terms of a pair never meet
    term, at = np.nonzero(here)
    impact = rng.integers(1, 50, len(term))
    impact[:3] += 60
    weight = np.ones(count, np.int64)

    def run(pairs):
        units = np.array([(k, k + 4, k) for k in range(4)] if pairs else [(k, k, -1) for k in range(8)], np.int64)
        pairs = units[:, :2] if pairs else np.zeros((0, 2), np.int64)
        plan = search.Plan(weight, docs, docs, pairs, *units.T, np.array([0, len(units)]))
        found = search.Search(plan, 3)
        for start in range(0, docs, 100):
            own = (at >= start) & (at < start + 100)
            place, lines = search._matrix(term[own], at[own] - start, impact[own], count, 100)
            none = np.zeros(0, np.int64)
            found.block(
                np.arange(start, start + 100), term[own], at[own] - start, impact[own], place.max(axis=1), none, none,
                np.zeros(1, np.int64), none,
            )
        return found

    alone, paired = run(False), run(True)
    total = np.zeros(docs, np.int64)
    np.add.at(total, at, impact)
    order = np.lexsort((np.arange(docs), -total))[:3]
    for found in (alone, paired):
        assert found.best[0][0].tolist() == order.tolist() and found.best[0][1].tolist() == total[order].tolist()
    assert paired.scored < alone.scored


@pytest.mark.parametrize("rows", [0, 700])
def test_divergence_on_awkward_tables(spark, monkeypatch, rows):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 7)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "MATRIX_CELLS", 4)
    monkeypatch.setattr(divergence, "HELD_ROWS", 10)
    docs = corpus(spark, rows)
    made = divergence.divergence(docs.withColumn("term", docs.text).withColumn("p", docs.doc_id))
    assert check.bag(made.columns, made.collect()) == by_sql(statements.DIVERGENCE, documents=docs)


def test_refinement_loses_no_kept_term(spark):
    docs = corpus(spark, 500, seed=8).fillna("", ["lang", "source", "text"])
    for levels in ((), (1,), (1, 2, 3, 4, 5, 6), (64,)):
        cells = divergence.kept_cells(docs.select("lang", "source", "text"), 6, levels)
        found = sorted(map(str, cells.collect()))
        first = found if levels == () else first
        assert found == first and found
