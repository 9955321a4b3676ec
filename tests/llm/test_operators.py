"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import html
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import common, decontaminate, minhash, pagediff, pieces, repeats, scoring, tokenfiles, toxicity, urls, vectors
from ledgerframe.llm.common import Scratch, setting, slices
from ledgerframe.llm.components import connected_components
from ledgerframe.llm.fingerprints import PUNCT, inside, ngrams, words

SPLIT = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, bands string, score double, n_chars long"


def split(text):
    return SPLIT.findall((text or "").translate(LOWER))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 0.5, len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, and every odd case."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = text(120).split(), text(70)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "A  b\nC"), (8, text(9000)), (9, "the " * 300), (10, "the " * 260)]
    for i in range(11, 60):
        w = list(base)
        for _ in range(rng.randrange(10)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(60, 75):
        rows.append((i, f"{text(rng.randrange(80))} {passage[: None if i % 3 else 500]} {text(rng.randrange(90))}"))
    rows += [(i, text(rng.randrange(5, 200))) for i in range(75, 130)]
    rows += [(130 + i, rows[70 + i][1]) for i in range(12)]
    rng.shuffle(rows)
    return rows


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_and_ngrams():
    w = words(pa.array(["Ab c", None, "", " ab\tC  é", "x"]))
    assert w.first.tolist() == [0, 2, 2, 2, 5, 6] and (w.hash[:2] == w.hash[2:4]).all()
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == ["Ab", "c", "ab", "C", "é", "x"]
    assert inside(w.first, 2).tolist() == [True, False, True, True, False]
    many = np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64)
    for k in (1, 3, 16, 17, 50):
        seen = {}
        for i, h in enumerate(ngrams(many, k).tolist()):
            assert seen.setdefault(h, tuple(many[i : i + k])) == tuple(many[i : i + k])
        assert len(set(ngrams(many, k).tolist())) == len({tuple(many[i : i + k]) for i in range(401 - k)})
    assert len(words(pa.array(["a.b-c"]), PUNCT).hash) == 3
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 9, None, "", "y" * 30, "z"])], ["t"])
    assert [b.num_rows for b in slices(iter([batch]), 0, 10)] == [3, 1, 1]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == groups({n for e in real for n in e}, real)
    assert connected_components(df.where("false"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, corpus, size):
    rows = [*corpus, (None, corpus[0][1]), corpus[5]]
    got = minhash.near_duplicates(docs_of(spark, rows), size).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t in corpus:
        w = split(t)
        sets[i] = {tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = groups(sets, links)
    assert len(links) > 50
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_repeated_passages(spark, corpus):
    n = 50
    rows = [*corpus, (None, "x " * 80), corpus[3]]
    w = {i: split(t) for i, t in corpus}
    owners = collections.defaultdict(set)
    for i, x in w.items():
        for a in range(len(x) - n + 1):
            owners[tuple(x[a : a + n])].add(i)
    expected = set()
    for i, x in w.items():
        for kept in (True, False):
            hits = [(a, min(o)) for a in range(len(x) - n + 1) if len(o := owners[tuple(x[a : a + n])]) > 1 and (min(o) == i) == kept]
            while hits:
                k = 1
                while k < len(hits) and hits[k][0] - hits[k - 1][0] <= n:
                    k += 1
                expected.add((i, hits[0][0], hits[k - 1][0] + n, kept, min(o for _, o in hits[:k])))
                hits = hits[k:]
    assert len(expected) > 40
    assert {tuple(r) for r in repeats.repeated_passages(docs_of(spark, rows)).collect()} == expected
    docs = docs_of(spark, rows)
    cut = repeats.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    gone = collections.defaultdict(set)
    for i, a, b, kept, _ in expected:
        if not kept:
            gone[i].update(range(a, b))
    for r in cut.collect():
        if r.doc_id is not None:
            assert split(r.text) == [x for j, x in enumerate(w[r.doc_id]) if j not in gone[r.doc_id]]
        assert r.n_chars is None or r.text is None or r.n_chars == len(r.text)
    assert repeats.repeated_passages(cut).where("not kept").count() == 0
    assert repeats.repeated_passages(docs_of(spark, [])).count() == 0 and repeats.remove_repeats(docs_of(spark, [])).count() == 0


def test_passages_repeated_within_one_document(spark, tmp_path):
    word = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    x, y = word(60, "x"), word(55, "y")
    rows = [(1, f"{x} a {x} b {x} c"), (2, f"{y} d {y}"), (3, f"e {y}"), (4, " ".join(["ha"] * 120)), (5, word(200, "z")), (6, None)]
    got = {tuple(r) for r in repeats.repeated_passages(docs_of(spark, rows), within=True).collect()}
    assert got == {(1, 0, 60, True, 1), (1, 61, 121, False, 1), (1, 122, 182, False, 1), (2, 0, 55, True, 2), (2, 56, 111, False, 2), (3, 1, 56, False, 2), (4, 0, 50, True, 4), (4, 50, 120, False, 4)}
    cut = {r.doc_id: r.text and r.text.split() for r in repeats.remove_repeats(docs_of(spark, rows), within=True).collect()}
    assert cut == {1: f"{x} a b c".split(), 2: f"{y} d".split(), 3: ["e"], 4: ["ha"] * 50, 5: rows[4][1].split(), 6: None}
    from ledgerframe.llm import queries

    docs_of(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r)[:5] for r in queries.op10_repeated_passages(spark, str(tmp_path)).collect()} == got


def edits(a, b):
    """The fewest edits between ``a`` and any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def test_decontamination(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefg", k=5)) for _ in range(4000)]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.randint(15, 60)))) for j in range(30)] + [(90, None), (91, ""), (None, "a b c d e"), (92, "Zq, zr!"), (0, None)]
    rows = [(-1, None), (-2, ""), (None, items[0][1]), (-3, "x zq ZR y"), (-4, "zq zz zr")]
    for i in range(500):
        w = items[i % 30][1].split()
        for _ in range(rng.randrange(len(w) // 3)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 1)] = [rng.choice(vocabulary)] if kind < 2 else []
        rows.append((i, " ".join([*rng.choices(vocabulary, k=rng.randrange(50)), *w, *rng.choices(vocabulary, k=rng.randrange(50))]).upper()))
    benchmark = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.benchmark_matches(docs_of(spark, rows), benchmark).collect()}
    expected = {(-3, 92): 0}
    for i, t in rows[5:]:
        for j, item in items[:30]:
            a = item.split()
            if (d := edits(a, t.lower().split())) <= int(0.2 * len(a) + 1e-9):
                expected[i, j] = d
    assert found.items() <= expected.items() and len(found) >= 0.99 * len(expected) and len(expected) > 250
    assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.benchmark_matches(docs_of(spark, rows), benchmark, group_bytes=900).collect()} == found
    clean = decontaminate.clean_documents(docs_of(spark, rows), benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in found}
    assert decontaminate.benchmark_matches(docs_of(spark, []), benchmark).count() == 0
    assert decontaminate.benchmark_matches(docs_of(spark, rows), benchmark.where("false")).count() == 0


def test_decontamination_of_long_items():
    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    items = [draw(n) for n in (61, 120, 240, 400, 800) for _ in range(4)]
    texts, planted = [], set()
    for t in range(200):
        j = t % len(items)
        w = list(items[j])
        for at in sorted(rng.sample(range(len(w)), int(0.2 * len(w) + 1e-9)), reverse=True):
            kind = 0 if t < 100 else rng.randrange(3)
            w[at : at + (kind != 1)] = draw(1) if kind < 2 else []
        texts.append(" ".join([*draw(rng.randrange(100)), *w, *draw(rng.randrange(100))]))
        planted.add((t, j))
    table = decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items])
    w = words(pa.array(texts, pa.string()), PUNCT)
    found = {(d, i): distance for d, i, distance, _ in decontaminate.matches(w.hash, w.first, table)}
    assert found.keys() <= planted and len(found) >= 0.99 * len(planted)
    assert all(v <= 0.2 * len(items[i]) for (_, i), v in found.items())


def test_sentencepiece(spark, corpus):
    rows = [*corpus, (None, "Ünïcode ☃ 𝒳 \x00 ﻿"), (501, "  two  spaces \n▁x "), (501, "a")]
    model = pieces.Pieces(pieces.fixed_path(pieces.MODEL)).model
    encoded = pieces.encode(docs_of(spark, rows))
    texts = collections.Counter((i, tuple(model.encode(t or "") + [model.eos_id()])) for i, t in rows)
    got = encoded.collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == texts
    by_ids = {tuple(model.encode(t or "") + [model.eos_id()]): t or "" for _, t in rows}
    for r in got:
        raw = by_ids[tuple(r.ids)].encode()
        assert r.decoded == model.decode(r.ids) and r.starts[-1] == r.ends[-1] == len(raw)
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == raw
    digest = pieces.digests(encoded).where("doc_id = 8").first()
    ids = model.encode(dict(corpus)[8]) + [model.eos_id()]
    assert (digest.n_tokens, digest.ids_sha256, digest.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    assert pieces.encode(docs_of(spark, [])).count() == 0


def test_character_map_against_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(normalizer.serialized_model_proto())
    charmap = pieces.CharMap(proto.normalizer_spec.precompiled_charsmap)
    for text in ("ﬁne ①② ＡＢＣ", "école ｶﾞ ㍿", "plain", "　x y", "½ Å"):
        raw, out, at = text.encode(), [], 0
        while at < len(raw):
            hit = charmap.longest(raw, at)
            n = hit[0] if hit else 1 + sum(raw[at] >= x for x in (0xC0, 0xE0, 0xF0))
            out.append(hit[1] if hit else raw[at : at + n])
            at += n
        assert " ".join(b"".join(out).decode().split()) == normalizer.normalize(text).replace("▁", " ").strip()


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenfiles.fixed_path(tokenfiles.TOKENIZER))
    rows = [*corpus, (None, "null id"), (500, "don't \x1c x y <|endoftext|> Σ"), (500, "a")]
    path = Scratch(spark, "t").path("tokens")
    tokenfiles.write_tokens(docs_of(spark, rows), path, part_bytes=9000)
    got = tokenfiles.checksums(tokenfiles.read_tokens(spark, path)).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id for r in tokenfiles.read_tokens(spark, path, 10, 20).collect()} == set(range(10, 20))
    assert tokenfiles.read_metadata(spark, path).count() == len(rows)
    tokenfiles.write_tokens(docs_of(spark, []), path)
    assert tokenfiles.read_metadata(spark, path).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(spark, corpus, order, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 20_000)
    rows = [*corpus, (None, "a b"), corpus[2]]
    w = [split(t) for _, t in rows]
    every = collections.Counter(tuple(x[a : a + k]) for x in w for k in range(1, order + 1) for a in range(len(x) - k + 1))
    total = sum(map(len, w))
    expected = []
    for (i, _), x in zip(rows, w, strict=True):
        own = collections.Counter(tuple(x[a : a + k]) for k in range(1, order + 1) for a in range(len(x) - k + 1))
        c = lambda g: every[g] - own[g]  # noqa: B023, E731
        s = 0.0
        for j in range(len(x)):
            value = 1.0
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(x[j - k + 1 : j + 1])
                if c(g) > 0:
                    value *= c(g) / (c(g[:-1]) if k > 1 else total - len(x))
                    break
                value *= 0.4 if k > 1 else 1 / (total - len(x) + 1)
            s += np.log(value)
        expected.append((i if i is not None else -1, len(x), round(s, 6)))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_words, round(r.log_score, 6)) for r in scoring.backoff_scores(docs_of(spark, rows), order).collect()]
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(expected)]
    assert np.allclose([x[2] for x in sorted(got)], [x[2] for x in sorted(expected)], atol=1e-5)
    assert scoring.backoff_scores(docs_of(spark, [])).count() == 0


def test_a_registered_query_scores_trigrams(spark, tmp_path):
    from ledgerframe.llm import queries

    docs_of(spark, [(1, "a b c"), (2, "x b d"), (3, "a b c")]).write.parquet(f"{tmp_path}/documents.parquet")
    logs = {k: {r.doc_id: r.log_score for r in queries.queries()[k](spark, str(tmp_path)).collect()} for k in ("op2_backoff_scores", "op2_backoff_scores_order3")}
    # others of document 1: a 1, b 2, c 1 of 6 words; "a b" 1, "b c" 1, "a b c" 1
    assert logs["op2_backoff_scores"][1] == pytest.approx(np.log(1 / 6 * 1 / 1 * 1 / 2), abs=1e-4)
    assert logs["op2_backoff_scores_order3"][1] == pytest.approx(np.log(1 / 6 * 1 / 1 * 1 / 1), abs=1e-4)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton():
    rng = random.Random(4)
    stems = ["".join(rng.choices("abc", k=rng.randint(4, 9))) for _ in range(12)]
    automaton = toxicity.Automaton(stems)
    for _ in range(4000):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 11)))
        if rng.random() < 0.5:
            word = list(rng.choice(stems))
            for _ in range(rng.randrange(3)):
                word[rng.randrange(len(word))] = rng.choice(["", "a", "bd", "c"])
            word = "".join(word)
        expected = 2 if any(word.startswith(s) for s in stems) else int(any(distance(word, s) <= (len(s) >= 5) + (len(s) >= 8) for s in stems))
        assert automaton.catch(word) == expected, word


def test_toxicity(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(900)]
    bad = ["villainous", "rotten", "scoundrel"]
    rows, labels = [(-1, None), (-2, ""), (None, "x")], []
    for i in range(900):
        w = rng.choices(vocabulary, k=rng.randint(5, 90))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                word = rng.choice(bad)
                w.insert(rng.randrange(len(w)), word if i < 600 else word.replace("o", "0", 1))  # misspelled where nothing is learned
        rows.append((i, " ".join(w)))
        if i < 600:
            labels.append((i, int(toxic), "x"))
    labels += [(700, None, ""), (None, 1, ""), (3, 0, "")]
    docs, labels = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    assert all(any(s.startswith(t) for s in bad) for t in model.stems) and model.stems
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900)) and not got[None].held_out
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.98
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in range(600, 900)]) > 0.9
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values()) and got[-1].predicted == got[-2].predicted == 0
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}
    assert toxicity.score(docs_of(spark, []), model).count() == 0
    # no label of a held-out row is ever read
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped).stems == model.stems
    reader = toxicity.Reader(["rotten"])
    abuse, quoted = reader.features("you are rotten"), reader.features("they wrote “how rotten it is” there")
    assert abuse[0] and abuse[3] and not abuse[2] and quoted[2] and not quoted[0]


def test_wide_lexicons_and_short_stems(spark):
    rng = random.Random(12)
    bad = ["".join(rng.choices("klmnpqrstvwxz", k=8)) for _ in range(500)]
    clean = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(600)]
    learned = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows, labels = [], []
    for n, i in enumerate(learned[:1000]):
        words_ = [*rng.choices(clean, k=20), *((bad[(20 * n + k) % 500] for k in range(20)) if n < 150 else ()), *(["scum", "dolt"] if n < 150 else ["bolt"] if n < 200 else [])]
        rows.append((i, " ".join(words_)))
        labels.append((i, int(n < 150)))
    model = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    automaton = model.reader().automaton
    assert len(model.stems) > 400 and all(automaton.catch(w) == 2 for w in bad)
    assert automaton.catch("scum") == 2 and automaton.catch("scvm") == 1
    assert automaton.catch("dolt") == 2 and automaton.catch("bolt") == automaton.catch("do1t") == 0  # clean documents hold a near word


def test_automata_of_wide_lexicons_take_bounded_memory(monkeypatch):
    rng = random.Random(3)
    stems, met = (["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 10))) for _ in range(n)] for n in (500, 3000))
    met += [w[:2] + w[3:] for w in stems if len(w) > 4]
    tracemalloc.start()
    automaton = toxicity.Automaton(stems)
    caught = [automaton.catch(w) for w in met]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20 << 20 and set(caught) == {0, 1, 2}  # 37 MB when states were sets of tuples
    # what is caught does not depend on how many states are held
    monkeypatch.setattr(toxicity, "MOST_STATES", 1 << 18)
    automaton, most = toxicity.Automaton(stems), 0
    for word, expected in zip(met, caught, strict=True):
        assert automaton.catch(word) == expected
        most = max(most, automaton.held)
    assert most < 1 << 19


def test_a_toxicity_fit_writes_few_files(spark, monkeypatch):
    files, write = {}, Scratch.write

    def counted(self, df, name, **options):
        out = write(self, df, name, **options)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    rows = [(i, f"text {i * 7919} {'villainous' if i % 5 == 0 else 'kind'}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    with setting(spark, "spark.sql.shuffle.partitions", "40"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        assert toxicity.fit(docs_of(spark, rows), labels).stems
    assert set(files) == {"sample", "terms"} and max(files.values()) <= spark.sparkContext.defaultParallelism


PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="http://b.com/y">'), (2, "http://b.com/y#z", "t"), (3, "http://c.org/q", '<meta http-equiv="refresh" content="0;url=http://b.com/y">'),
    (4, "http://e.com/fr/1", "<link rel=canonical href=/fr/2>"), (5, "http://e.com/fr/2", ""), (6, None, None), (7, "nourl", "<link rel=canonical href=z>"), (8, "https://x.org/fr/1", '<link href="//k.net/a" rel="canonical">'),
    (9, "http://k.net/a", None), (10, "http://z.EXAMPLE.net/en/1?a#b", "x"), (11, "http://Z.Example.NET", "x"), (12, "ftp://w.info/u", '<link rel="canonical" href="http://k.net/a">'),
    (13, "http://m.info/dir/p1", '<link rel="canonical" href="p2">'), (14, "http://m.info/dir/p2", '<link rel="canonical" href="http://blocked.net/">'), (14, "http://m.info/dir/p2", None), (15, "http://notnet/a", ""), (16, "http://a.example.com/de/1", ""),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert urls.judge(df).count() == len(PAGES)
    assert got == {
        1: ("net/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("org/fr/", "allow"), 9: ("net/", "block"),
        10: ("example.net/en/", "allow"), 11: (None, "allow"), 12: (None, "allow"), 13: (None, "block"), 14: (None, "block"), 15: (None, "allow"), 16: ("example.com/de/", "block"),
    }
    r = urls.judge(df).where("page_id = 10").first()
    assert (r.host, r.path) == ("z.example.net", "/en/1")
    assert urls.judge(df.where("false")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64))
    near = x[:100] + 0.2 * rng.standard_normal((100, 64))
    hot = x[200] + 0.1 * rng.standard_normal((60, 64))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(1000 + i, v.tolist(), int(i % 3)) for i, v in enumerate(near)] + [(2000 + i, v.tolist(), 2) for i, v in enumerate(hot)]
    rows += [(3000 + i, x[i].tolist(), int(i % 3)) for i in range(30)] + [(4000, None, 1), (4001, [0.0] * 64, 1), (4002, [None, *[1.0] * 63], 1), (4003, [float("nan")] * 64, 1), (4004, x[0].tolist(), None), (None, x[0].tolist(), 0), (4005, [1.0], 0), (4006, [], 0)]
    good = [(i, np.array(v), k) for i, v, k in rows if i is not None and k is not None and v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for j, a in enumerate(good) for b in good[:j] if a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, id int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows)
    count = collections.Counter(x for pair in links for x in pair)
    found = sum(r.n_links for r in got.values())
    assert all(r.n_links <= count[i] for i, r in got.items()) and found >= 0.95 * 2 * len(links) > 3000
    assert got[4001].n_links == 0 and got[4001].kept and got[None].kept and got[3005].component_id == 5
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_main_text(spark):
    menu = "<nav>menu</nav><div class='ad'>buy</div><script>x('</p>')</script><!-- c --><aside>s</aside><form>f</form><div id='comments'><p>reader</p></div>"
    page = lambda body: f"<html><head><title>T</title></head><body>{menu}{body}<footer>foot</footer></body></html>"
    rows = [
        (1, "http://h/a/1", page("<article><h1>A &amp; B</h1><p>one<br>two<p>same line</article>")), (2, "http://h/a/2", page("<article><h1>A &amp; B</h1><p>one<br>two<p>same line</article>")),
        (3, "http://h/b/1", "<p>Site name</p><p>first story</p><p>All rights reserved</p>"), (4, "http://h/b/2", "<p>Site name</p><p>second story</p><p>All rights reserved</p>"),
        (5, None, "<p>kept</p><p>all"), (6, "x", None), (7, "http://h/c", "a &lt; b &am"), (8, "http://other/b/1", "<div class=sidebar>never closed<article><p>x</p></article>"), (9, "http://solo/", "<p>only"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, part string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in pagediff.main_text(df).collect()}
    want = {1: "A & B\none two\nsame line", 2: "A & B\none two\nsame line", 3: "first story", 4: "second story", 5: "kept\nall", 6: "", 7: "a < b &am", 8: "x", 9: "only"}
    assert {i: x[1] for i, x in got.items()} == want and all(x[2] == len(x[1]) for x in got.values()) and got[1][0] == rows[0][1]
    assert pagediff.main_text(df.where("false")).count() == 0


def test_main_text_of_copies_and_of_lines_outside_the_article(spark):
    story = "<p>Site name</p><p>a story</p><p>told once</p>"
    page = lambda n: f"<p>Site name</p><main><p>body {n}</p><article><p>teaser {n}</p></article></main><p>Imprint</p>"
    rows = [(1, "http://h/a", story), (2, "https://h/a", story), (3, "http://h/a?utm=1", story), (4, "http://g/x", story), (5, "http://g/x", story), (6, "http://g/y", "<p>Site name</p><p>other"), (7, "http://k/1", page(1)), (8, "http://k/2", page(2))]
    got = {r.page_id: r.text for r in pagediff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "Site name\na story\ntold once"
    assert got == {1: whole, 2: whole, 3: whole, 4: whole, 5: "a story\ntold once", 6: "other", 7: "body 1\nteaser 1", 8: "body 2\nteaser 2"}


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found, rest = pagediff.shared_lines(a, b), iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in sorted(found))
    assert html.unescape("&am") == "&am"


def test_near_duplicates_of_ids_that_repeat_with_other_texts(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(5, a), (5, b), (9, f"{b} x"), (7, f"{a} y"), (11, c), (11, c), (12, f"{c} z"), (13, "d e"), (14, None)]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {(5, 26): (5, True), (9, 27): (5, False), (7, 27): (5, False), (11, 26): (11, True), (12, 27): (11, False), (13, 1): (13, True), (14, 0): (14, True)}


def test_a_large_group_held_together_by_one_text(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base))]
    for i in range(2, 152):
        w = list(base)
        for at in rng.sample(range(0, 200, 5), 5):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    # all are linked with the first and with no other, so their buckets are large and few of them have the first as centre
    assert all(linked(sets[0], x) for x in sets[1:]) and not any(linked(x, y) for i, x in enumerate(sets[1:]) for y in sets[1 : i + 1])
    assert {r.component_id for r in minhash.near_duplicates(docs_of(spark, rows), size=4).collect()} == {1}


def test_without_ids_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (None, "c", 4), (2, "d", 5)], "doc_id int, gone string, Gone_ int")
    left = common.without_ids(docs, spark.createDataFrame([(2,)], "x long"))
    assert left.columns == docs.columns and {tuple(r) for r in left.collect()} == {(1, "a", 2), (None, "c", 4)}


def test_decontamination_judges_rows(spark):
    words_ = [f"w{i}" for i in range(200)]
    item, other = " ".join(words_[:30]), " ".join(words_[30:60])
    rows = [(1, f"x {item} y", 0), (1, "clean text", 0), (2, f"{other} {' '.join(words_[60:]) * 400}", 1), (None, item, 2), (3, None, 3), (4, "", 4), (5, item, 5), (5, item, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, known int")
    benchmark = spark.createDataFrame([(7, item), (8, other), (7, item), (7, "zz zy zx zw zv")], "item_id long, text string")
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and sorted(tuple(r)[::2] for r in clean.collect() if r.doc_id) == [(1, 0), (3, 3), (4, 4)]
    assert sum(r.doc_id is None for r in clean.collect()) == 1
    assert sorted(map(tuple, decontaminate.clean_documents(docs, benchmark, group_bytes=100).collect()), key=str) == sorted(map(tuple, clean.collect()), key=str)
    found = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_matches(docs, benchmark).collect()}
    assert found == {(1, 7), (2, 8), (5, 7)}


def test_repeats_of_ids_that_repeat_with_other_texts(spark):
    word = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    x, y = word(60, "x"), word(100, "y")
    rows = [(1, f"{x} a", 0), (1, y, 1), (2, f"b {x}", 2), (3, f"{y} c", 3), (3, f"{y} c", 4), (None, x, 5), (4, "short", 6), (5, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, starts int").withColumn("row_id", F.lit("z"))
    cut = repeats.remove_repeats(docs)
    assert cut.columns == docs.columns
    assert {r.starts: r.text for r in cut.collect()} == {0: f"{x} a", 1: y, 2: "b ", 3: " c".lstrip(), 4: "c", 5: x, 6: "short", 7: None}
    spans = sorted(tuple(r) for r in repeats.repeated_passages(docs).collect())
    assert spans == [(1, 0, 60, True, 1), (1, 0, 100, True, 1), (2, 1, 61, False, 1), (3, 0, 100, False, 1)]


def test_runs_over_several_ranges(spark, monkeypatch):
    """A passage of most documents, in ranges far smaller than its run."""
    monkeypatch.setattr(repeats, "PART_ROWS", 40)
    x = " ".join(f"x{i}" for i in range(70))
    docs = docs_of(spark, [(i, f"p{i} {x} q{i}" if i % 3 else f"r{i} s") for i in range(90)])
    assert {tuple(r) for r in repeats.repeated_passages(docs).collect()} == {(i, 1, 71, i == 1, 1) for i in range(90) if i % 3}
    assert {tuple(r) for r in repeats.repeated_passages(docs, within=True).collect()} == {(i, 1, 71, i == 1, 1) for i in range(90) if i % 3}


def test_main_text_against_brute_force(spark, monkeypatch):
    """Random pages with and without an article, in many hosts and one large one, over several ranges; rows that repeat, nulls, a very long page."""
    monkeypatch.setattr(pagediff, "PART_ROWS", 20)
    rng = random.Random(9)
    lines = [f"line {i}" for i in range(12)]
    rows = [(None, None, None), (0, "http://a/long", "".join(f"<p>l{i % 50}" for i in range(30_000))), (1, "http://a/lon", "".join(f"<p>l{i % 49}" for i in range(500)))]
    for i in range(2, 150):
        body = "".join(f"<p>{x}</p>" for x in rng.choices(lines, k=rng.randrange(7)))
        if i % 3 == 0:
            body += f"<article><h1>{rng.choice(lines)}</h1><p>story {i}</p><p>{rng.choice(lines)}</p></article><p>{rng.choice(lines)}</p>"
        rows.append((i, f"http://{rng.choice(['a', 'a', 'b', f'c{i}'])}/{rng.choice('xy')}/{rng.randrange(40)}", body))
    rows += rows[5:9]
    distinct = []
    for page_id, url, body in sorted(set(rows), key=lambda r: (r[1] is not None, r[1] or "", r[0] or 0)):
        found, main = pagediff.page_lines(body or "")
        host, path = (url.split("/", 3)[2], "/" + url.split("/", 3)[3]) if url else ("", "")
        distinct.append({"row": (page_id, url, body), "host": host, "path": path, "url": url or "", "page_id": page_id or -1, "lines": found, "main": main})
    distinct.sort(key=lambda p: (p["host"], p["path"], p["url"], p["page_id"]))
    want, removed = {}, 0
    for i, p in enumerate(distinct):
        gone = pagediff.template_lines(p, distinct[i - 1] if i else None, distinct[i + 1] if i + 1 < len(distinct) else None)
        with_article = "<article>" in (p["row"][2] or "")
        removed += bool(gone) and with_article
        want[p["row"]] = "\n".join(x for k, x in enumerate(p["lines"]) if k not in set(gone))
    assert removed > 5  # pages with an article are paired and lose template lines too
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, part int")
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in pagediff.main_text(df).collect())
    assert got == collections.Counter((r[0], r[1], want[r], len(want[r])) for r in rows)


def test_packed_numbers():
    rng = np.random.default_rng(4)
    for values in ([], [0], [1, 1, 900, 1], [2**64 - 1, 5], rng.integers(0, 2**44, 3000), rng.geometric(0.4, 5000), [0, 2**63, *[3] * 300]):
        x = np.array(values, np.uint64)
        assert (scoring._unpacked(scoring._packed(x)) == x).all()
    gaps = np.diff(np.sort(rng.integers(0, 2**64, 200_000, dtype=np.uint64)))
    assert len(scoring._packed(gaps)) < 6.1 * len(gaps)


def test_token_ids_of_odd_words(monkeypatch):
    """Against the library: marks, case, special tokens, odd white space, long words, a table of few slots, a pool that is emptied."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "SLOT_BITS", 6)
    monkeypatch.setattr(tokenfiles, "POOL_IDS", 3000)
    path = tokenfiles.fixed_path(tokenfiles.TOKENIZER)
    library, encoder, rng = Tokenizer.from_file(path), tokenfiles._Encoder(path, 1), random.Random(1)
    texts = ["".join(rng.choices("abAB é’'<|>endoftext\x1c  \t\n\x0b0123.,-ßİſ́\xa0", k=rng.randrange(40))) for _ in range(1500)]
    texts += ["<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", None, "", " ", "a" * 5000 + " b", "İ", "ab " * 300, "À à"]
    for batch in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])]), 0, 4000):
        ids, counts = encoder.encode(batch.column(0))
        got = np.split(ids, np.cumsum(counts))[:-1]
        assert [x.tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in batch.column(0).to_pylist()]


def test_alignment_through_a_character_map():
    """Models with a map and every mix of prefix, squeezed and escaped white space: pieces cover the library's normalised text, spans the source."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    map_of = sentencepiece_model_pb2.ModelProto()
    map_of.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    with open(pieces.fixed_path(pieces.MODEL), "rb") as f:
        base = f.read()
    for prefix, squeeze, escape in ((True, True, True), (False, True, True), (True, False, True), (False, False, True)):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(base)
        spec = proto.normalizer_spec
        spec.precompiled_charsmap = map_of.normalizer_spec.precompiled_charsmap
        spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = prefix, squeeze, escape
        own = pieces.Pieces.of(proto)
        for text in ("ﬁne ①② ＡＢＣ", "  two   spaces　wide ", "école ｶﾞ ㍿ ½ Å", "plain", "", "   ", "x​y\x00z ﷺ", "ＡＢ " * 300):
            ids = own.encode([text])[0]
            begin, end = own.spans(text, ids)
            raw = text.encode()
            known = own.model.encode(text, out_type="proto").pieces
            assert len(begin) == len(ids) == len(known)
            assert all(0 <= a <= b <= len(raw) for a, b in zip(begin, end, strict=True)) and list(begin) == sorted(begin)
            assert len(own.align(text)[0]) == sum(1 if own.model.is_byte(p.id) else len(p.piece.encode()) for p in known), text
            for a, b in zip(begin, end, strict=True):
                raw[a:b].decode()  # a span never cuts a character of the source, but for byte pieces


def test_near_vectors_of_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 64))
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    rows += [(100, [1.0, 2.0], "a"), (101, [2.0, 4.0], "a"), (102, [2.0, -4.0], "a"), (103, [1.0, 2.0, 0.0], "a"), (104, [1.0, 2.0], "b"), (105, [-3.0], "a"), (106, [-1.0], "a"), (107, [1.0], "a")]
    long = rng.standard_normal(1000)
    rows += [(110, long.tolist(), "a"), (111, (long + 0.05 * rng.standard_normal(1000)).tolist(), "a")]
    rows += [(200, x[0].tolist(), "a"), (200, x[1].tolist(), "a"), (201, (1.5 * x[2]).tolist(), "a"), (202, (2 * x[2]).tolist(), "a")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label string")
    got = {}
    for r in vectors.near_vectors(df).collect():
        got.setdefault(r.vec_id, set()).add((r.n_links, r.component_id, r.kept))
    assert got[100] == {(1, 100, True)} and got[101] == {(1, 100, False)} and got[102] == {(0, 102, True)} and got[103] == {(0, 103, True)} and got[104] == {(0, 104, True)}
    assert got[105] == {(1, 105, True)} and got[106] == {(1, 105, False)} and got[107] == {(0, 107, True)}
    assert got[110] == {(1, 110, True)} and got[111] == {(1, 110, False)}
    assert got[0] == {(1, 0, True)} and got[1] == {(1, 0, False)} and got[200] == {(1, 0, False)}  # one id with two vectors ties both together
    assert got[2] == {(2, 2, True)} and got[201] == {(2, 2, False)} and got[3] == {(0, 3, True)}


def test_dense_groups_of_vectors(spark, monkeypatch):
    """Near copies in blocks far smaller than their bucket: counts and components by brute force."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3, 64))
    x = np.concatenate([b + 0.22 * rng.standard_normal((70, 64)) for b in base] + [rng.standard_normal((80, 64))])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist(), i % 2) for i in range(20)]
    unit = np.array([r[1] for r in rows])
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label) & (ids[:, None] != ids)
    want = groups(ids.tolist(), [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(linked), strict=True)])
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    count = dict(zip(ids.tolist(), linked.sum(1).tolist(), strict=True))
    assert all(r.n_links <= count[i] for i, r in got.items()) and sum(r.n_links for r in got.values()) >= 0.98 * linked.sum() > 2000
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.97
    assert (vectors.spanning(np.array([[0, 1, 0, 0], [1, 0, 0, 1], [0, 0, 0, 0], [0, 1, 0, 0]], bool)) == [0, 0, 2, 0]).all()


@pytest.mark.parametrize("within", [False, True])
def test_comparing_sorted_ranges_in_batches(within):
    """Runs that begin and end anywhere in ranges and batches give the rows that all together would give."""
    rng = random.Random(13)
    for _ in range(60):
        rows = sorted((k, rng.randrange(4), rng.randrange(2), rng.randrange(3)) for k in range(12) for _ in range(rng.choice([1, 1, 2, 3, 9])))
        cuts = sorted(rng.sample(range(len(rows) + 1), 3))
        found, edges = [], {}
        for part in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            size = rng.randrange(1, 6)
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part[a : a + size], strict=True)], ["key", "doc_id", "tag", "place"]) for a in range(0, len(part), size)]
            for batch in repeats._compare(within)(iter(batches)):
                found += batch.to_pylist()
        for r in found:
            if r["edge"] or r["mark"]:
                edges.setdefault(r["key"], set()).add((r["doc_id"], r["tag"], r["place"] if within else 0))
        got = []
        for r in found:
            if r["mark"] or r["edge"] and len(edges[r["key"]]) < 2:
                continue
            least = min(edges[r["key"]])[:2] if r["key"] in edges else None
            own = (r["doc_id"], r["tag"]) == least if least else r["own"]
            got.append((r["key"], r["doc_id"], r["tag"], r["place"], least[0] if least else r["source"], own))
        want = []
        for k, d, t, p in rows:
            same = [(x[1], x[2], x[3] if within else 0) for x in rows if x[0] == k]
            if len(set(same)) > 1:
                want.append((k, d, t, p, min(same)[0], (d, t) == min(same)[:2]))
        assert sorted(got) == sorted(want)


def test_toxicity_of_very_long_and_repeated_rows(spark):
    model = toxicity.Model(["rotten", "scoundrel"], frozenset(), [2.0, 0.0, -1.0, 0.5, 0.5, 0.0, -1.0])
    filler = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, f"{filler} you rotten scoundrel"), (2, filler), (3, "rotten"), (3, "rotten"), (3, "kind"), (4, "r0tten"), (None, "rotten"), (5, "ü" * 10_000)]
    got = sorted((r.doc_id or 0, r.predicted) for r in toxicity.score(docs_of(spark, rows), model, threshold=0.45).collect())
    assert got == [(0, 1), (1, 1), (2, 0), (3, 0), (3, 1), (3, 1), (4, 1), (5, 0)]
    assert toxicity.chance(3, 0, 0.1) == pytest.approx(1e-3) and toxicity.chance(0, 5, 0.1) == 1.0 and toxicity.chance(1, 1, 0.5) == pytest.approx(0.75)


def test_url_rules_of_very_long_pages(spark):
    filler = "<p>text</p>" * 200_000
    rows = [(1, "http://a.org/x", f'{filler}<link rel="canonical" href="http://b.net/y">'), (2, "http://c.org/" + "p" * 100_000, filler), (1, "http://a.org/x", f'{filler}<link rel="canonical" href="http://b.net/y">')]
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, None, "block"), (1, None, "block"), (2, None, "allow")]
