"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import ann, components, decontamination, language_id, line_dedup, near_dups, packing, quality, rans, simhash, token_counts, token_files, warc
from folioscope.llm.chunked_encoding import ChunkedEncoder
from tests.sql_check import plain

LONG = " ".join(f"w{i % 977} and then\n" if i % 9 == 0 else f"w{i % 977}" for i in range(60_000))
CLASH = "rank int, size int, key int, pos int, h int, node int, th int, f0 int, part int, start int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", len(LONG)), (4, LONG, "de", "b", len(LONG)), (4, LONG, "de", "b", len(LONG)), (None, "one two three", "en", None, 1), (None, None, None, None, None), (5, " \n \t", "fr", "c", 3), (6, "Ünïcode 日本語 русский \U0001f600", "xx", "c", 9)]


def edge(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *range(10)) for r in rows], SCHEMA)


BPE = lambda n: public_tokenizers.path(n)
OPERATORS = {
    "token_counts": lambda s, d: token_counts.token_counts(d, BPE("piece_bpe_32k.model")),
    "token_files": lambda s, d: token_files.read_token_files(s, token_files.write_token_files(d, BPE("word_bpe_49k.json"), 2)),
    "language": lambda s, d: language_id.predict(d, language_id.learn(d)),
    "quality": lambda s, d: quality.score(d, quality.learn(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "simhash": lambda s, d: simhash.near_groups(d),
    "near": lambda s, d: near_dups.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_a_result(spark, name):
    got = OPERATORS[name](spark, edge(spark))
    assert got.count() == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, edge(spark, [])).count() == 0


def test_packing_of_edges(spark):
    got = packing.pack(edge(spark), BPE("byte_bpe_50k.json"), 1).toPandas()
    assert len(got[got.length == got.doc_tokens].query("doc_tokens == 1")) == 3  # two nulls and an empty text
    assert packing.pack(edge(spark, []), BPE("byte_bpe_50k.json"), 1).count() == 0


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w10 w11 w12 w13 w14 w15"), (2, None), (3, ""), (None, "one two three four five six seven eight"), (4, "a b")], "item_id long, text string")
    docs = edge(spark)
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0
    assert {r.item_id for r in decontamination.leaks(docs, bench).collect()} <= {1}
    small = decontamination.leaks(docs, bench, block_bytes=1).collect()  # a pass for each item
    assert sorted(map(str, small)) == sorted(map(str, decontamination.leaks(docs, bench).collect()))
    assert decontamination.without_leaks(docs, bench).columns == docs.columns


def test_reparameterised_question():
    items = decontamination.prepare([(1, "Tom has 12 apples and gives 5 of them to Mary before he walks 3 km home to see the old house again")])
    other = "well then Anna has 7 apples and gives 4 of them to Peter before he walks 9 miles home to see the old house again yes"
    broken = "Anna has 7 apples and gives 7 of them to Peter before he walks 9 miles home to see the old house again"
    assert [m[:2] for m in decontamination.matches(items, decontamination.Canon(), [other, broken, "has apples"])] == [(0, 0)]


def test_pipeline_on_edges(spark):
    docs = edge(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    assert near_dups.keep_one(docs).count() < docs.count()
    assert {r.doc_id for r in near_dups.keep_one(docs).collect()} >= {3, 6}


def test_vectors_that_take_no_part(spark):
    good = [(i, [float(i % 7), 1.0, -float(i % 3)]) for i in range(60)]
    bad = [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 2.0]), (180, [float("nan"), 1.0, 1.0]), (200, [float("inf"), 1.0, 1.0]), (220, [1.0]), (None, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame([(*r, 1) for r in good + bad], "vec_id long, embedding array<float>, rank int")
    got = ann.search(rows, k=5).toPandas()
    assert sorted(got.query_id.unique()) == [0, 20, 40] and got.vec_id.max() < 60
    x = np.array([v for _, v in good])
    for q, own in got.groupby("query_id"):
        want = sorted((-float(x[i] @ x[q]), i) for i in range(60) if i != q)[:5]
        assert list(zip(own.sort_values("rank").vec_id, own.sort_values("rank").score)) == [(i, -s) for s, i in want]
    assert ann.search(rows.limit(0)).count() == 0


def test_warc_edges(spark):
    pages = spark.createDataFrame([(5, "http://a b\n", "same"), (3, None, "same"), (3, "http://c", "same"), (7, "http://d", None), (8, "http://e", ""), (None, "http://f", "same"), (9, "x", "ü\r\n\r\n")], "page_id long, url string, html string")
    folder = warc.write_warc(pages, roll_bytes=1)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == 7
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("3", "response", None)] * 2 + [("5", "revisit", 3), ("7", "response", None), ("8", "revisit", 7), ("9", "response", None), ("None", "revisit", 3)]
    assert {r.payload.decode() for r in got if r.page_id == 9} == {"ü\r\n\r\n"}
    assert all(r.record_type == "response" for r in warc.read_warc(spark, warc.write_warc(pages, revisit_from=5)).collect())
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0


def test_rans_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 1000, rans.BLOCK + 777):
        ids = np.minimum(rng.geometric(0.01, n), 4999).astype(np.uint32)
        coder = rans.Coder(rans.quantized(np.bincount(ids, minlength=5000)))
        data = rans.file_bytes(coder, 0, [], ids)
        blocks = rans.read_index(data)["blocks"]
        assert np.array_equal(np.concatenate([rans.read_block(coder, data, b) for b in blocks[::-1]][::-1] or [ids]), ids)
    broken = bytearray(data)
    broken[100] ^= 1
    with pytest.raises(ValueError):
        rans.read_block(coder, bytes(broken), blocks[0])


def test_encoders_equal_the_libraries():
    pick = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "b", "É", "’s", "'s", "12", "½", "ﬁ", "\x1c", "\x85", "\xa0", "　", "中文", "<|endoftext|>", "<s>", ".", "!?", "é", "Σ", "İ", "ß", "\r\n", "▁", "\x01", "word,", "Next."]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(14))) for _ in range(8000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(BPE(name))
        assert ChunkedEncoder(BPE(name)).encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    m, c = sentencepiece.SentencePieceProcessor(model_file=BPE("piece_bpe_32k.model")), token_counts.PieceCounter(BPE("piece_bpe_32k.model"))
    assert [c.count(t) for t in texts] == [len(m.encode(t)) for t in texts]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_crowded_lookups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(40)] * 2 + [" ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs, similarity=0.7).collect()}
    sets = [set(near_dups.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(a & b) >= 0.7 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i] for i in range(len(texts))] == root


def test_line_runs(spark):
    run = "\n".join(f"line {i} " + "x " * 9 for i in range(6))  # 66 words
    docs = spark.createDataFrame([(1, f"top\n{run}\nend"), (2, f"other\n{run}\nlast"), (3, "top\nend"), (4, "a " * 55 + "\nb\n" + "a " * 55)], "doc_id long, text string")
    got = {r.doc_id: plain(tuple(r)[1:]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[2] == ["other\nlast", 6, 66] and got[3] == ["top\nend", 0, 0] and got[4] == ["a " * 55 + "\nb", 1, 55] and got[1][1] == 0


def test_near_duplicates_by_edits_of_a_block(spark):
    """Lone pairs with a block of words appended, cut or replaced, at similarities of 0.8 to 0.9."""
    rng, texts, fresh = random.Random(11), [], iter(range(10**9))
    words = lambda n: [f"v{next(fresh)}" for _ in range(n)]
    for k in range(450):
        base, share = words(rng.randrange(120, 400)), rng.choice([0.8, 0.8, 0.85, 0.9])
        n = len(base) - 4
        at = rng.randrange(10, n // 2)
        more = int(n * (1 / share - 1))  # appended: n of n + more shingles are shared
        cut = int(n * (1 - share)) - 8  # the seam spoils four shingles more and makes four
        new = int(n * (1 - share) / (1 + share)) - 4
        texts += [base, (base + words(more), base[:at] + base[at + cut :], base[:at] + words(new) + base[at + new :])[k % 3]]
    texts = [" ".join(t) for t in texts]
    sets = [set(near_dups.shingle_set(t, 5).tolist()) for t in texts]
    wanted = [i for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(wanted) > 400
    for kind in range(3):
        own = [i for i in wanted if i // 2 % 3 == kind]
        assert np.mean([got[i + 1] == i for i in own]) >= 0.99
    assert all(got[i] == i for i in range(0, len(texts), 2)) and all(got[i + 1] == i + 1 for i in range(0, len(texts), 2) if i not in wanted)


def test_line_runs_behind_long_lines(spark):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    run = f"{words('a', 120)}\n{words('b', 40)}"
    rows = [(1, f"{run}\nend"), (2, f"other\n{run}\nlast"), (3, run), (4, f"{words('a', 120)}\nx\n{words('b', 40)}")]
    got = {r.doc_id: plain(tuple(r)[1:]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1] == 0 and got[2] == ["other\nlast", 2, 160] and got[3] == ["", 2, 160] and got[4] == [f"x\n{words('b', 40)}", 1, 120]


def leaked(items, texts):
    found = decontamination.matches(decontamination.prepare(list(enumerate(items))), decontamination.Canon(), texts)
    return sorted(m[:2] for m in found)


def test_items_of_few_plain_words():
    items = ["Alice, Bob, Carol and Dave each have 3, 5, 7 and 9 coins.", "Add 3 and 5", "12 kg"]
    texts = [f"so we ask that {x} and then go on" for x in items] + ["Alice, Bob, Carol and Dave each have 3, 5, 7 and 8 coins.", "add 3 to 5 and 12 mg", None]
    assert leaked(items, texts) == [(0, 0), (1, 1), (2, 2)]


def test_short_items_inside_sentences_and_in_lower_case():
    items = ["Which of the two trains will reach the town first", "Tell Anna and Peter where the old house stood", "How many apples are left when he gives 5 of them"]
    texts = [f"Question: {items[0]}", f"and - {items[1]} so", items[1].lower(), "Question: How many apples are left when he gives 7 of them", "Answer: Few many apples are left when he gives 7 of them"]
    assert leaked(items, texts) == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_a_long_labelled_text_leaves_the_others(spark):
    first = spark.range(200).orderBy(F.xxhash64("id")).first().id
    texts = [(i, "fine words of sense" if i % 2 else "junk junk junk") for i in range(200)]
    docs = spark.createDataFrame([(i, t * 2000 if i == first else t) for i, t in texts], "doc_id long, text string")
    field = quality.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), sample_bytes=16_000)
    assert [r.predicted for r in quality.score(docs.where("doc_id <= 41"), field, threshold=0.7).orderBy("doc_id").collect()] == [i % 2 for i in range(42)]


def test_passages_of_long_items():
    words = [f"plain{k}" for k in range(100)]
    assert leaked([" ".join(words)], [" ".join(["x", *words[20 : 20 + n], "y"]) for n in (12, 13, 39, 40)]) == [(1, 0), (2, 0), (3, 0)]


def plain_line_dedup(texts, least):
    """Lines to delete, by comparing every run of lines with every earlier place of it."""
    own = [[(p, x) for p, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for d, lines in enumerate(own):
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[d].update(p for p, _ in lines[a : b + 1])
                    seen.add(run)
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if p not in g) for t, g in zip(texts, gone)]


def test_line_dedup_equals_all_runs(spark):
    pick = random.Random(9)
    line = lambda k: " ".join([f"t{k}"] * (1 + k * 7 % 9))
    texts = ["\n".join(pick.choice(["", "  ", line(pick.randrange(5)), line(pick.randrange(12))]) for _ in range(pick.randrange(40))) for _ in range(60)]
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    a, b, y = words("a", 11), "b", words("y", 9)
    texts += ["\n".join(x) for x in ([a, b, "x"], [a, b, y, "z2"], [a, b, y, "z3"])]  # the run A B Y stands whole in the second only
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_words=12).orderBy("doc_id").collect()
    assert [r.text for r in got] == plain_line_dedup(texts, 12)
    assert got[-1].text == "z3" and got[-2].text == f"{y}\nz2"


def test_line_dedup_of_clashing_names_nulls_and_repeats(spark):
    run = "\n".join(f"line {i} " + "x " * 9 for i in range(6))
    rows = [(None, run, 1, 7), (1, run, 2, 7), (1, run, 3, 7), (2, None, 4, 7), (3, "", 5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped_lines int, own_0 int")
    got = line_dedup.dedup_lines(docs, names=("lost", "lost_words")).collect()
    assert sorted((r.dropped_lines, r.text, r.lost, r.own_0) for r in got if r.text is not None) == [(1, run, 0, 7), (2, "", 6, 7), (3, "", 6, 7), (5, "", 0, 7)]
    assert line_dedup.dedup_lines(docs).columns == ["doc_id", "text", "own_0", "dropped_lines", "dropped_words"]


def test_neighbours_among_many_vectors_in_few_lists():
    """Recall over whole lists, and the share of vectors looked at, of 50,000 vectors around 500 centres."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(500, 32))[rng.integers(0, 500, 50_000)] + rng.normal(0, 0.4, (50_000, 32))).astype(np.float32)
    shape = ann.fit(x[rng.permutation(50_000)[:20_000]], len(x), 20)
    own = shape.lists(x)
    held = np.bincount(own, minlength=len(shape.centroids))
    asked = rng.choice(len(x), 100, replace=False)
    scores = x[asked] @ x.T
    scores[np.arange(100), asked] = -np.inf
    best = np.argsort(-scores, 1)[:, :20]
    seen = shape.visited(x[asked], held, 21)
    assert np.mean([np.isin(own[b], v).mean() for b, v in zip(best, seen)]) >= 0.9
    assert np.mean([held[v].sum() for v in seen]) / len(x) < 0.25
    assert len(shape.centroids) == 224


def test_lists_of_two_levels_and_short_lists(monkeypatch):
    monkeypatch.setattr(ann, "_DIRECT", 10)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 8)).astype(np.float32)
    shape = ann.fit(x, len(x), 5)
    assert shape.tops is not None and shape.below[-1] == len(shape.centroids)
    assert np.mean(shape.lists(x) == ann.nearest(x, shape.centroids)) > 0.95
    held = np.bincount(shape.lists(x), minlength=len(shape.centroids))
    assert all(held[v].sum() >= 500 for v in shape.visited(x[:50], held, 500))


def test_double_vectors_keep_their_precision(spark):
    rows = spark.createDataFrame([(i, [1.0 + i * 1e-12, 1e300 if i == 3 else 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    got = {r.query_id: r for r in ann.search(rows, k=1).collect()}
    assert got[0].vec_id == 3 and got[0].score == 1e300 + 1.0 + 3e-12
    one = ann.search(rows.where("vec_id <> 3"), k=3).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in one] == [29, 28, 27] and one[0].score == 2.0 + 29e-12


def test_numerals_alone_are_no_language(spark):
    docs = spark.createDataFrame([(1, "½ ² ① Ⅷ 12"), (2, "x² y"), (3, "__ !"), (4, "plain words here")], "doc_id long, text string")
    model = language_id.learn(docs.where("doc_id = 4").selectExpr("text", "'en' as lang"))
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs, model).orderBy("doc_id").collect()] == [("und", 0.0), ("en", 1.0), ("und", 0.0), ("en", 1.0)]


def test_units_stand_behind_numbers_only():
    kind = lambda t: decontamination.Canon().sequence([t.split()])[1].tolist()
    assert kind("a bar of 5 kg was a cent") == [0, 0, 0, 1, 2, 0, 0, 0]
    item = "Why is a bar of a cent in a second h or in a minute s"
    assert leaked([item], [f"so we ask {item.lower()} and then"]) == [(0, 0)]


def test_archives_are_read_in_proportion_to_their_size():
    made = [warc.record(i, "u", b"x" * (i % 50), None, "2024-01-01T00:00:00Z") for i in range(3000)]
    data = b"".join(made)
    for size in (1, 1000, 1 << 14, len(data)):
        got = [int(f["X-Page-ID"]) for f, _ in warc.records(data[at : at + size] for at in range(0, len(data), size))]
        assert got == list(range(3000))
    with pytest.raises(ValueError):
        list(warc.records([data[:-1]]))


def test_null_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_A_PART", 16)
    monkeypatch.setattr(token_files, "ROWS_A_PART", 16)
    pages = spark.createDataFrame([(None if i % 3 else i, f"http://{i}", f"page {i}") for i in range(200)], "page_id long, url string, html string")
    folder = warc.write_warc(pages)
    assert len([1 for p in __import__("pathlib").Path(folder.removeprefix("file://")).glob("part-*")]) > 8
    assert sorted((str(r.page_id), r.payload.decode()) for r in warc.read_warc(spark, folder).collect()) == sorted((str(r.page_id), r.html) for r in pages.collect())
    docs = pages.selectExpr("page_id as doc_id", "html as text")
    got = token_files.read_token_files(spark, token_files.write_token_files(docs, BPE("word_bpe_49k.json"), 2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda d: (d is not None, d)) and len(got) == 200
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_files_of_ids_roll(spark, monkeypatch):
    monkeypatch.setattr(token_files, "IDS_A_FILE", 50)
    docs = spark.createDataFrame([(i, " ".join(f"word{j}" for j in range(i * 7 % 60))) for i in range(40)], "doc_id long, text string")
    whole = Tokenizer.from_file(BPE("word_bpe_49k.json"))
    got = token_files.read_token_files(spark, token_files.write_token_files(docs, BPE("word_bpe_49k.json"), 2)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.orderBy("doc_id").collect()]


def plain_fingerprint(text):
    """From the words of the contract, one bit at a time."""
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_links_by_their_definition(spark):
    pick = random.Random(8)
    texts = [r[0] for r in ROWS[:0]] + [None, "", " \n", "One", "ÄÖ Two\x0bthree", LONG]
    base = [f"w{i}" for i in range(60)]
    texts += [" ".join(pick.choice(["X", w]) if pick.random() < 0.03 else w for w in base) for _ in range(120)]
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_groups(docs).select("doc_id", simhash.hex_print("fp").alias("f"), "component_id").orderBy("doc_id").collect()
    assert [r.f for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == root


def test_every_choice_of_segments_finds_all_near_prints(spark, monkeypatch):
    pick = random.Random(4)
    prints = [pick.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in pick.sample(range(64), 4)) for p in prints]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    for count in (2, 3, 4, 5):
        got = {tuple(sorted(r)) for r in simhash.near_links(rows, ["fp"], [(0, *x) for x in simhash.segments(4, count)], 4).collect()}
        assert got == {(i, i + 60) for i in range(60)}
    assert len(simhash.fitting(4, 10**10)) < len(simhash.fitting(4, 10**4))


def test_components_by_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)], "a long, b long")
    want = {i: 0 for i in range(41)} | {100: 100, 200: 100, 150: 100}
    for small in (0, 10**6):
        got = {r.node: r.root for r in components.components(edges, small).collect()}
        assert all(got.get(x, x) == r for x, r in want.items())


def test_groups_over_many_batches():
    import pyarrow as pa

    rows = [(g, i) for g, n in enumerate([1, 5, 30, 2, 40, 1]) for i in range(n)]
    batches = [pa.RecordBatch.from_pydict({"group": [g for g, _ in rows[a : a + 7]], "raw": [bytes([i]) for _, i in rows[a : a + 7]]}) for a in range(0, len(rows), 7)]
    out = list(simhash.by_group(lambda b: (b.column("group").to_pylist(), b.column("raw").to_pylist()))(iter(batches)))
    assert [x for g, r in out for x in zip(g, r)] == [(g, bytes([i])) for g, i in rows]
    assert sum(len(set(g)) for g, _ in out) == 6  # no group is cut


def test_viterbi_equals_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    model = language_id.LanguageModel(["a", "b", "c"], np.zeros((language_id.SLOTS, 3), np.float32), np.ones((len(language_id.NAMES), 3), bool))
    label = language_id.Labeller(model, 2.0)
    label.known, label.scores = {f"w{i}": i for i in range(9)}, rng.normal(0, 3, (9, 3)).astype(np.float32)
    docs = [[f"w{i}" for i in rng.integers(0, 9, n)] for n in (0, 1, 2, 5, 6)]
    for words, states in zip(docs, label.states(docs)):
        value = lambda path: sum(label.scores[label.known[w], s] for w, s in zip(words, path)) - 2 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max((value(p) for p in product(range(3), repeat=len(words))), default=0)
        assert len(states) == len(words) and np.isclose(value(states.tolist()), best, atol=1e-4)


def test_marginals_equal_all_labellings():
    from itertools import product

    rng = np.random.default_rng(3)
    score, ties, sizes = rng.normal(0, 2, 11), np.array([0.7, -0.3]), np.array([1, 4, 6])
    got, kept = quality._chains(score, ties, sizes)
    want, pairs, first = [], np.zeros(2), 0
    for n in sizes:
        own = score[first : first + n]
        ways = [(y, np.exp(sum(own[i] * y[i] for i in range(n)) + sum(ties[0] if a and b else ties[1] if not a and not b else 0 for a, b in zip(y, y[1:])))) for y in product((0, 1), repeat=int(n))]
        total = sum(w for _, w in ways)
        want += [sum(w for y, w in ways if y[i]) / total for i in range(n)]
        pairs += [sum(w * sum(a == b == s for a, b in zip(y, y[1:])) for y, w in ways) / total for s in (1, 0)]
        first += n
    assert np.allclose(got, want) and np.allclose(kept, pairs)


def test_values_of_edge_rows(spark):
    docs = edge(spark)
    words = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_groups(docs).where("doc_id is not null").collect()}
    assert words[1] == words[2] == words[5] == (0, 1) and words[3] == words[4]
    near = {(r.doc_id, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (5, 1), (3, 3), (4, 3), (6, 6)} <= near
    field = quality.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    marks = {r.doc_id: r for r in quality.score(docs, field).where("doc_id is not null").collect()}
    assert marks[1].score == marks[2].score and len(marks[1].lines) == 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in marks.values())
    assert quality.keep_good(docs, field, 0.0).count() == len(ROWS) and quality.keep_good(docs, field, 1.1).count() == 0
    langs = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.learn(docs)).collect()}
    assert langs[1] == langs[2] == langs[5] == "und" and langs[3] == langs[4] != "und"


def test_reparameterised_leaks_through_the_query(spark):
    bench = spark.createDataFrame([(1, "Tom has 12 apples and gives 5 of them to Mary before he walks 3 km home to see the old house again")], "item_id long, text string")
    texts = ["so Anna has 7 apples and gives 4 of them to Peter before he walks 9 miles home to see the old house again", "Anna has 7 apples and gives 7 of them to Peter before he walks 9 miles home to see the old house again", "no leak at all"]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()) == [(0, 1), (3, 1)]
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, bench).collect()) == [1, 2, 4, 5]
