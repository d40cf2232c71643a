"""Operators on documents: against plain versions on a small table, and on awkward rows."""
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import edit_embedding, language, latent_leaks, licences, paragraph_bands, passages, queries, simhash, token_counts, transducer
from . import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{brute.SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


# --- language -----------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark, docs):
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, brute.SF).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == lang.keys()
    held = [d for d, r in got.items() if r["held_out"]]
    import zlib
    assert sorted(held) == sorted(d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2)
    assert sum(got[d]["lang_pred"] == lang[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark):
    docs = brute.edge_docs(spark)
    model = language.learn(docs.select("doc_id", "text", "lang"), ~language.held_out(F.col("doc_id")))
    got = language.identify(docs.select("doc_id", "text"), model).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    none = language.learn(brute.no_docs(spark).select("doc_id", "text", "lang"), ~language.held_out(F.col("doc_id")))
    assert {r["lang_pred"] for r in language.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert language.identify(brute.no_docs(spark).select("text"), none).count() == 0
    assert language.keep_known(docs).columns == docs.columns


def test_codes_correct_one_wrong_bit():
    import numpy as np
    for n in (4, 9):
        codes = language.code_matrix(n)
        apart = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= 3
    m = language.Model(["a", "b", "c", "d"], language.code_matrix(4), None, np.full(language.code_matrix(4).shape, 1 / 7))
    margins = 0.9 * m.codes.astype(float)
    margins[:, 0] *= -1
    assert m.decode(margins)[0].tolist() == [0, 1, 2, 3]


# --- simhash ------------------------------------------------------------------------------------

def test_simhash_is_brute_force(docs, rows):
    got = [(r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got) == sorted(brute.simhash_groups(rows))


def test_simhash_edges(spark):
    docs = brute.edge_docs(spark)
    want = brute.simhash_groups([(r[0], r[1]) for r in brute.edge_rows()])
    got = [(r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(brute.no_docs(spark)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id = 5").count() == 1
    assert simhash.one_of_each(docs.where("doc_id = 6")).count() == 1
    assert simhash.one_of_each(brute.no_docs(spark)).count() == 0


def test_simhash_crowded_keys(spark, monkeypatch):
    """Links are exact where a key is crowded."""
    import random
    rnd = random.Random(3)
    prints = {0}
    while len(prints) < 300:
        p = rnd.choice([*prints])
        prints.add(p ^ 1 << rnd.randrange(63) ^ (1 << rnd.randrange(63) if rnd.random() < .7 else 0))
    far = {rnd.getrandbits(63) for _ in range(50)}
    each = sorted(prints | far)
    u = brute.Union()
    for i, a in enumerate(each):
        for b in each[:i]:
            if (a ^ b).bit_count() <= 2:
                u.join(a, b)
    monkeypatch.setattr(simhash, "CROWD", 4)
    frame = spark.createDataFrame([(p,) for p in each], "fp bigint")
    v = brute.Union()
    for r in simhash.links(frame).collect():
        assert (r["a"] ^ r["b"]).bit_count() <= 4
        v.join(r["a"], r["b"])
    groups = lambda w: sorted(sorted(p for p in each if w.find(p) == root) for root in {w.find(p) for p in each})
    assert groups(u) == groups(v)


# --- tokens -------------------------------------------------------------------------------------

def _counts(texts):
    return [(len(t.encode()), len(ids)) for t, (ids, _) in zip(texts, brute.tokens(texts))]


@pytest.mark.parametrize("edge", [False, True])
def test_token_counts(spark, docs, rows, edge):
    table, rows = (brute.edge_docs(spark), [r[:2] for r in brute.edge_rows()]) if edge else (docs, rows)
    got = token_counts.token_counts(table, brute.TOKENIZER, 1024, hot=50).collect()
    want = [(d, b, n, n > 1024) for (d, _), (b, n) in zip(rows, _counts([t or "" for _, t in rows]))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_tokens_of_nothing(spark):
    assert token_counts.token_counts(brute.no_docs(spark), brute.TOKENIZER, 1024).count() == 0
    assert transducer.round_trip(brute.no_docs(spark), brute.TOKENIZER).count() == 0


@pytest.mark.parametrize("edge", [False, True])
def test_bpe_round_trip(spark, docs, rows, edge):
    table, rows = (brute.edge_docs(spark), [r[:2] for r in brute.edge_rows()]) if edge else (docs, rows)
    got = [(r["doc_id"], r["ids"], r["text"]) for r in transducer.round_trip(table, brute.TOKENIZER, words=500).collect()]
    want = [(d, *made) for (d, _), made in zip(rows, brute.tokens([t or "" for _, t in rows]))]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_transducer_holds_exactly_its_words(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["a", "ab", "abc", "xbc", "xb", "é", "zz" * 40])}
    path = tmp_path / "lexicon"
    path.write_bytes(transducer.compile_lexicon(words))
    lex = transducer.Lexicon(str(path))
    asked = [*words, b"b", b"abcd", b"x", b"zz"]
    ranks = lex.ranks(asked).tolist()
    assert [lex.of(r).tolist() if r >= 0 else None for r in ranks] == [words.get(w) for w in asked]
    assert len(lex.end) < sum(map(len, words))  # shared suffixes


# --- edit fingerprints --------------------------------------------------------------------------

@pytest.mark.parametrize("edge", [False, True])
def test_edited_fingerprints(spark, docs, rows, edge):
    table, rows = (brute.edge_docs(spark), [r[:2] for r in brute.edge_rows()]) if edge else (docs, rows)
    got = edit_embedding.edited_fingerprints(table).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (d, t), (_, n) in zip(order, [*order[1:], order[0]]):
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        a, b, c = edit_embedding.fingerprints([t, e, n])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, edit_embedding.likeness(a, b), edit_embedding.likeness(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    if not edge:
        near = [r["near_edited"] for r in got if r["n_chars"] > 200]
        far = [r["near_next"] for r in got if r["n_chars"] > 200]
        assert sum(near) / len(near) > sum(far) / len(far) + 0.2


def test_no_edited_fingerprints(spark):
    assert edit_embedding.edited_fingerprints(brute.no_docs(spark)).count() == 0


def test_near_texts_are_grouped(spark, monkeypatch):
    import random
    rnd = random.Random(9)
    text = lambda: "".join(rnd.choice("abcdefghij klmno pqrst") for _ in range(3000))
    rows, want = [], {}
    for g in range(12):
        base = text()
        for k in range(5):
            t = list(base)
            for _ in range(4 * min(k, 1)):
                t[rnd.randrange(len(t))] = rnd.choice(["", "zz", "y"])
            rows.append((10 * g + k, "".join(t)))
            want[10 * g + k] = 10 * g
    rows += [(500, None), (501, ""), (None, text())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, key int")
    for crowd in (64, 2):
        monkeypatch.setattr(edit_embedding, "CROWD", crowd)
        got = {r["doc_id"]: r["group_id"] for r in edit_embedding.near_groups(df).collect()}
        assert {d: got[d] for d in (500, 501, None)} == {500: 500, 501: 500, None: None}
        assert all(got[d] // 10 == d // 10 for d in want)
        assert sum(got[d] == g for d, g in want.items()) >= 0.9 * len(want)
    assert edit_embedding.near_groups(brute.no_docs(spark)).count() == 0


# --- paragraphs ---------------------------------------------------------------------------------

def test_paragraph_clusters_are_brute_force(docs, rows):
    got = {}
    for r in paragraph_bands.repeats(docs).collect():
        got.setdefault(r["cluster"], []).append(r)
    assert sorted(sorted((r["doc_id"], r["place"]) for r in g) for g in got.values()) == brute.paragraph_clusters(rows)
    for g in got.values():
        first = min((r["doc_id"], r["at"], r["place"]) for r in g)
        assert [r["kept"] for r in g] == [(r["doc_id"], r["at"], r["place"]) == first for r in g]
        assert {r["keeper"] for r in g} == {first[0]}


def test_paragraph_edges(spark):
    docs = brute.edge_docs(spark)
    made = paragraph_bands.remove_repeats(docs)
    assert made.columns == docs.columns and made.dtypes == docs.dtypes
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in made.collect())
    want = [(0 if i is None else i, "" if i == 6 else "and a tail" if i == 7 else t or "") for i, t, *_ in brute.edge_rows()]
    assert texts == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in made.collect() if r["text"] is not None)
    assert paragraph_bands.repeats(brute.no_docs(spark)).count() == 0
    assert paragraph_bands.remove_repeats(brute.no_docs(spark)).count() == 0


def test_crowded_band_keys(spark, monkeypatch):
    """Near copies of one paragraph, more than a key may pair out, end in one cluster."""
    import random
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for d in range(1, 61):
        w = base[:]
        w[rnd.randrange(200)] = f"x{d}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, " ".join(f"v{rnd.randrange(10**6)}" for _ in range(60))) for d in range(20)]
    monkeypatch.setattr(paragraph_bands, "CROWD", 8)
    got = paragraph_bands.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len({r["cluster"] for r in got}) == 1 and sorted(r["doc_id"] for r in got) == list(range(61))
    assert [r["doc_id"] for r in got if r["kept"]] == [0]


def test_lines_that_repeat_themselves(spark):
    """Similarity is of sets of shingles, however often a line says them."""
    once = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(once * 4)), (2, " ".join(once)), (3, " ".join(f"v{i}" for i in range(50)))]
    got = paragraph_bands.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [sorted((r["doc_id"], r["place"]) for r in got)] == brute.paragraph_clusters(rows)
    assert sorted(r["doc_id"] for r in got) == [1, 2]


def test_passages_inside_lines_and_across_wraps(spark):
    import random
    rnd = random.Random(4)
    made = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    wrap = lambda w, k: "\n".join(" ".join(w[i:i + k]) for i in range(0, len(w), k))
    run, other, third = made(60), made(55), made(49)
    han = "".join(chr(0x4e00 + rnd.randrange(5000)) for _ in range(80))
    spaceless = "".join(rnd.choice("abcdefghijklmno") for _ in range(900))
    own = [made(40) for _ in range(8)]
    line = lambda k, w: " ".join(own[k] + w + own[k + 1])
    texts = {1: line(0, run), 2: line(2, [w.upper() + "," for w in run]), 3: wrap(own[4] + run, 9),
             4: "top\n" + wrap(other, 7), 5: "other head\n" + wrap(other, 11) + "\ntail", 6: line(5, third), 7: " ".join(own[7] + third),
             8: han[:5] + "甲" + han, 9: "乙丙" + han + "丁", 10: "start " + spaceless, 11: "begin " + spaceless}
    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    found = [r for r in paragraph_bands.with_passages(docs).collect() if r["begin"] is not None]
    assert {(r["doc_id"], r["kept"], r["keeper"], r["n_words"]) for r in found if r["doc_id"] < 8} == {
        (1, True, 1, 60), (2, False, 1, 60), (3, False, 1, 60), (4, True, 4, 55), (5, False, 4, 55)}
    cut = {r["doc_id"]: texts[r["doc_id"]][r["begin"]:r["end"]] for r in found}
    assert cut.keys() == {1, 2, 3, 4, 5, 8, 9, 10, 11} and cut[1].split() == run and cut[3].split() == run and cut[5].split() == other
    assert cut[2].lower().replace(",", "").split() == run and cut[9] == han and len(cut[11]) > 850
    assert len({r["cluster"] for r in found}) == 4


def test_words_have_places():
    hashes = passages.Hashes()
    for text in (brute.LONG, "a, b -- c\u00a0d\x1ce 日本語 テキスト! " + "xyaz" * 40, "", " | ", "\ud800 x", "wörd\u2028two"):
        places = hashes.places(text)
        assert [h for b, e in places.tolist() for h in hashes.of(text[b:e]).tolist()] == hashes.of(text).tolist()


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """All classes share a key; links form chains that do not pass through the pivot."""
    import random
    rnd = random.Random(8)
    rows = []
    head = [f"same{i}" for i in range(30)]
    for chain in range(6):
        w = [f"c{chain}_{i}" for i in range(60)]
        for k in range(12):
            rows.append((len(rows), " ".join(head + w)))
            for _ in range(2):
                w[rnd.randrange(60)] = f"x{chain}_{k}_{rnd.random()}"
    rows.append((len(rows), " ".join(head + [f"p{i}" for i in range(90)])))

    def one_key(texts, numbers):
        keys, distinct = paragraph_bands.band_keys(texts, numbers)
        lists = pa.array((keys * 0).tolist(), pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([lists, pa.array(distinct)], names=["keys", "distinct"])

    monkeypatch.setattr(paragraph_bands, "_keys", one_key)
    monkeypatch.setattr(paragraph_bands, "CROWD", 8)
    monkeypatch.setattr(paragraph_bands, "BLOCK", 10)
    got = {}
    for r in paragraph_bands.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r["cluster"], []).append((r["doc_id"], r["place"]))
    assert len(got) >= 6 and sorted(map(sorted, got.values())) == brute.paragraph_clusters(rows)


# --- benchmark leaks ----------------------------------------------------------------------------

def test_leaks_find_planted_items(spark, docs, rows):
    items = spark.read.parquet(f"{brute.SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in latent_leaks.leaks(docs, items).collect()}
    want = {(d, i) for i, item in [tuple(r) for r in items.select("item_id", "text").collect()] for d, t in rows if brute.holds(t, item)}
    assert want and got == want


def test_leaks_find_paraphrases(spark):
    items = spark.read.parquet(f"{brute.SF}/benchmark.parquet")
    filler = " ".join(f"filler{i}" for i in range(300))
    rows, want = [], set()
    for k, (i, text) in enumerate([tuple(r) for r in items.select("item_id", "text").collect()]):
        w = text.split()
        if len(w) < 24:
            continue
        changed = [x if j % 11 != 5 else f"other{j}" for j, x in enumerate(w)]
        changed.insert(7, "moreover")
        rows.append((k, f"{filler} {' '.join(changed).upper()}! {filler}"))
        want.add((k, i))
    rows.append((10_000, filler))
    got = {(r["doc_id"], r["item_id"]) for r in latent_leaks.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    assert got == want


def test_leaks_edges(spark):
    docs = brute.edge_docs(spark)
    items = spark.createDataFrame([(1, brute.LONG, None), (1, brute.LONG, None), (2, None, None), (None, "", None), (3, "few words", None),
                                   (4, "no such question in any text of these at all", "forty two")], "item_id bigint, text string, answer string")
    got = sorted((r["doc_id"], r["item_id"]) for r in latent_leaks.leaks(docs, items).collect())
    assert got == [(4, 3), (5, 1), (6, 1), (6, 1), (7, 1)]
    kept = latent_leaks.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted((r[0] or 0) for r in brute.edge_rows() if r[0] not in (4, 5, 6, 7))
    assert latent_leaks.leaks(brute.no_docs(spark), items).count() == 0
    assert latent_leaks.leaks(docs, items.where("false")).count() == 0
    assert latent_leaks.decontaminate(docs, items.where("false")).count() == docs.count()


def test_long_texts_and_items(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(300))
    text = " ".join(f"t{i % 977}" for i in range(5000))
    monkeypatch.setattr(latent_leaks, "BLOCK", 2)
    rows = [(1, text + " " + item + " " + text), (2, text)]
    got = latent_leaks.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id int, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(1, 7)]


def test_blocks_of_passages_are_exact(spark, monkeypatch):
    """No block has more passages than the space has dimensions, and repeated rows stay at every size."""
    items = [(i, " ".join(f"q{i}x{j}" for j in range(9 if i % 2 else 60))) for i in range(7)]
    rows = [(i, f"before it {t} after it") for i, t in items] + [(3, f"before it {items[3][1]} after it"), (50, "nothing of them")]
    sizes, build = [], latent_leaks.build
    monkeypatch.setattr(latent_leaks, "BLOCK", 4)
    monkeypatch.setattr(latent_leaks, "build", lambda docs, block, ids: sizes.append(len(block)) or build(docs, block, ids))
    got = latent_leaks.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == sorted((d, i) for d, t in rows for i, x in items if brute.holds(t, x))
    assert sizes == [4, 3]


# --- licences -----------------------------------------------------------------------------------

def test_licences(spark):
    mit = licences.TEXTS["MIT", "MIT License"]
    rows = [(1, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.upper()), (2, "Text before\nReleased under the M.I.T... no\n"),
            (3, "Some prose.\nLicenced   under the APACHE licence, version 2.0\nmore"), (4, None), (5, ""), (6, "!!!"), (6, "!!!"),
            (7, "prose with Released under the MIT License. inside"), (8, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, at int, DIGEST string")
    got = sorted((r["doc_id"], r["whole"], tuple(r["licenses"]), r["n_licenses"]) for r in licences.scan(docs, licences.known(spark)).collect())
    assert got == [(1, "MIT", ("MIT",), 1), (2, None, (), 0), (3, None, ("Apache-2.0",), 1), (4, None, (), 0), (5, None, (), 0), (6, None, (), 0),
                   (6, None, (), 0), (7, None, (), 0), (8, None, ("CC-BY-NC-4.0", "MIT"), 2)]
    assert licences.scan(brute.no_docs(spark), licences.known(spark)).count() == 0


def test_lexicon_is_the_whole_vocabulary():
    """Its words depend on the tokenizer only, not on a part of the texts, and have the library's ids."""
    from tapeloom.llm.pretokens import Cutter, tokenizer
    words, cut = transducer.vocabulary_words(brute.TOKENIZER), Cutter(brute.TOKENIZER)
    tok, merge = tokenizer(brute.TOKENIZER), transducer.merger(brute.TOKENIZER)
    assert len(words) == len(set(words)) and {" the", "."} < set(words)
    whole = [w for w in words if cut(w) == [w]]
    assert len(whole) > 40_000
    assert [merge(w) for w in whole] == [e.ids for e in tok.encode_batch_fast(whole, add_special_tokens=False)]


# --- memory and shuffles ------------------------------------------------------------------------

def test_margins_of_a_long_text_are_small():
    """A slice, not the text, decides how many rows of log odds are held at once."""
    import tracemalloc

    import numpy as np
    codes = language.code_matrix(6)
    model = language.Model(list("abcdef"), codes, np.zeros((language.BUCKETS + 1, codes.shape[1]), np.float32))
    tracemalloc.start()
    margins = model.margins(["some words of a text " * 60_000, "short"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert margins.shape == (2, codes.shape[1]) and peak < 64 << 20


def test_round_trip_takes_one_worker_a_task(spark, docs):
    made = transducer.round_trip(docs, brute.TOKENIZER, words=500)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_only_documents_with_lost_lines_are_joined(spark, monkeypatch):
    rows = [(d, "\n".join(" ".join(f"w{d}_{i}_{k}" for k in range(25)) for i in range(3))) for d in range(60)]
    rows[7] = (7, rows[7][1] + "\n" + rows[3][1].split("\n")[1])
    joined, stage = [], paragraph_bands.stage

    def count(df):
        out = stage(df)
        if {"text", "gone"} <= {*df.columns}:
            joined.append(out.count())
        return out

    monkeypatch.setattr(paragraph_bands, "stage", count)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = paragraph_bands.with_passages(table).collect()
    assert sorted((r["doc_id"], r["place"], r["kept"]) for r in found) == [(3, 1, True), (7, 3, False)] and joined == [1]
    left = {r["doc_id"]: r["text"] for r in paragraph_bands.remove_repeats(table).collect()}
    assert left == {**dict(rows), 7: rows[7][1].rsplit("\n", 1)[0]}


def test_copies_in_many_tasks_are_one_class(spark):
    line = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(d, line) for d in range(40)], "doc_id bigint, text string").repartition(5)
    pairs, crowd = paragraph_bands.candidates(paragraph_bands._listed(docs))
    assert pairs.count() == crowd.count() == 0
    assert [(r["doc_id"], r["keeper"]) for r in paragraph_bands.repeats(docs).collect() if r["kept"]] == [(0, 0)]


def test_plain_words_are_the_pattern():
    tokens = ["", "a", "(a)", "_a_", "don't", "--", "İ", "İ!", "«été»", "é_", "x́", "́x", "\ud800", "½,", "a-b.", "١٢٣", "ß'S"]
    assert [paragraph_bands.plain(t) for t in tokens] == [paragraph_bands._ENDS.sub("", t.lower()) for t in tokens]


def test_filter_holds_its_hashes(spark):
    import numpy as np
    from tapeloom.llm import common
    hashes = [0, 1, -1, 31, 32, 63, 2**63 - 1, -2**63, common.FILTER, -common.FILTER - 5]
    bits = common.filter_of(spark.createDataFrame([(h,) for h in hashes], "h bigint"), "h")
    assert common.in_filter(bits, np.array(hashes)).all() and common.in_filter(bits, np.arange(1000)).sum() == 5
    none = common.filter_of(spark.createDataFrame([], "h bigint"), "h")
    assert not common.in_filter(none, np.arange(1000)).any()


def test_passages_are_cut_out(spark):
    """Passages inside lines and across line breaks are removed where they repeat; the rest of a text stays."""
    import random
    import corpus_pipeline
    rnd = random.Random(9)
    made = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    wrap = lambda w, k: "\n".join(" ".join(w[i:i + k]) for i in range(0, len(w), k))
    run, other, short, line, own = made(60), made(52), made(49), made(30), made(50)
    a, b, c, d = (" ".join(made(40)) for _ in range(4))
    texts = {1: f"{a} {' '.join(run)} {b}", 2: f"{c} {' '.join(w.upper() + ',' for w in run)} {d}", 3: f"head\n{wrap(run, 9)}\n\ntail {wrap(other, 8)}",
             4: f"top {wrap(other, 7)} end\n" + " ".join(line), 5: " ".join(line) + "\n" + " ".join(own[:25] + short), 6: " ".join(short + own[25:]), 7: None, 8: ""}
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars int")
    made = corpus_pipeline.substring_dedup(spark, docs, brute.SF)
    assert made.dtypes == docs.dtypes
    got = {r["doc_id"]: r["text"] for r in made.collect()}
    assert got == {**texts, 2: f"{c}  {d}", 3: f"head\n\ntail {wrap(other, 8)}", 4: "top \n end\n" + " ".join(line), 5: " ".join(own[:25] + short)}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in made.collect())


def test_remainders():
    cut = paragraph_bands.remainder
    text = "one two\n\nthree four\nfive"
    assert cut(text, [], [], []) == text and cut(text, [0, 1, 2, 3], [], []) == ""
    assert cut(text, [], [4], [7]) == "one \n\nthree four\nfive"
    assert cut(text, [], [4], [14]) == "one \n four\nfive"
    assert cut(text, [], [0], [19]) == "five" and cut(text, [3], [9], [14]) == "one two\n\n four"
    assert cut(text, [], [0, 9, 15], [3, 14, 24]) == " two\n"
    for begin in range(len(text)):
        for end in range(begin + 1, len(text) + 1):
            kept = text[:begin] + text[end:]
            assert cut(text, [], [begin], [end]).split() == [p for i, line in enumerate(text.split("\n")) for p in
                                                              "".join(ch for j, ch in enumerate(line, sum(len(x) + 1 for x in text.split("\n")[:i]))
                                                                      if not begin <= j < end).split()] and len(kept) < len(text)
