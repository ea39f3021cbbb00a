"""The ten operators against brute force, and on rows that are null, empty, equal or very long."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import ann, fingerprints, html_extract, licenses, lm, mixing, near_copies, packing, pii, simhash, toxicity
from tessera.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, target double, key string"


def table(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), 1.0, 7, 2.0, "k") for i, t, s in rows], DOCS)


def edge_rows():
    words = "one two three four five six seven"
    return [(1, words, "a"), (2, None, "a"), (3, "", None), (4, " \t\n", "b"), (5, words, "b"), (6, "Ä漢😀 é " * 3000, "c"), (7, "x", "a"), (8, words, "a"), (8, words, "a"), (None, "lone", None), (None, "lone", None)]


def test_toxicity_finds_insults_and_keeps_clean_texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{rng.randint(0, 400)}" for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = rng.choices(vocabulary, k=rng.randint(10, 80))
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorkelbad", "moron"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    docs = table(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "zorkelbad" in model.lexicon.words
    out = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert np.mean([(out[i] >= 0.3) == bool(t) for i, _, t in labels]) > 0.97
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {i for i in out if out[i] < 0.3}
    edge = table(spark, edge_rows())
    scores = [r.score for r in toxicity.scored(edge, model).collect()]
    assert len(scores) == len(edge_rows()) and all(0 <= s <= 1 for s in scores)
    assert toxicity.without_toxic(edge.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).score(["", "a"]).tolist() == [0.5, 0.5]


def test_isotonic_is_monotone():
    from tessera.llm.boosting import calibrated, fit_isotonic

    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * x))).astype(float)
    out = calibrated(np.sort(x), *fit_isotonic(x, y))
    assert (np.diff(out) >= 0).all() and 0 <= out.min() and out.max() <= 1


def test_fingerprints_against_direct_computation(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta"], k=rng.randint(0, 400))), "s") for i in range(60)]
    out = {r.doc_id: r for r in fingerprints.fingerprinted(table(spark, rows), parts=5).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, text, _) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        own = fingerprints.edited(text, follower)
        assert out[i].edited_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert out[i].fingerprint == fingerprints.written(fingerprints.chunks(text))
        assert out[i].near_next == fingerprints.likeness(fingerprints.chunks(text), fingerprints.chunks(follower))
    assert fingerprints.fingerprinted(table(spark, edge_rows())).count() == len(edge_rows())
    assert fingerprints.fingerprinted(table(spark, [])).count() == 0


def test_chunks_survive_a_shift():
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    a, b = fingerprints.chunks(text), fingerprints.chunks("a few new words " + text)
    assert fingerprints.likeness(a, b) > 0.97
    assert fingerprints.read(fingerprints.written(a)) == a


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:260] = x[200]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, cell int")
    found: dict[int, list] = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), block=300).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = x.astype(np.float64)
    norm = np.sqrt((y * y).sum(1))
    hits = []
    for q in range(0, 1500, 50):
        score = (y * y[q]).sum(1) / (norm * norm[q])
        best = [j for j in np.lexsort((np.arange(1500), -score)) if j != q][:5]
        got = [v for _, v, _ in sorted(found[q])]
        assert len(got) == 5 and q not in got
        hits.append(len(set(got) & set(best)) / 5)
    assert np.mean(hits) >= 0.9
    assert [v for _, v, _ in sorted(found[200])] == [201, 202, 203, 204, 205]
    odd = [(0, None), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (None, [1.0, 1.0]), (6, [1.0])]
    small = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(small, small.where("vec_id % 50 = 0")).collect()] == [(50, 1, 1)]
    assert ann.nearest(small.limit(0), small.limit(0)).count() == 0


def test_main_text(spark):
    from tessera.llm.labelled_pages import labelled_page

    weights = html_extract.default_weights()
    right = sum(html_extract.main_text(page, weights).split("\n") == blocks for page, blocks in map(labelled_page, range(5000, 5200)))
    assert right >= 190
    page = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><nav><a href=1>Home</a><a href=2>News</a></nav>
      <article><h1>Head &amp; line</h1><p>First   <b>bo</b>ld paragraph of the story goes here.</p><aside>related things</aside><div class="advert">buy now</div>
      <p>Second&nbsp;one, also with a good many words in it.</p><section id="comments"><p>I think so too, said a reader.</p></section></article><footer>&copy; us</footer>"""
    assert html_extract.main_text(page, weights) == "Head & line\nFirst bold paragraph of the story goes here.\nSecond one, also with a good many words in it."
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>only words"), (4, "u", "<<<>>> &amp <a <b"), (5, "u", "<div>" * 3000 + "deep words" + "</p>" * 3000), (5, "u", page), (5, "u", page)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = html_extract.extracted(pages).collect()
    assert len(out) == 7 and all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_simhash_components(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=60)) for _ in range(30)]
    rows = [(i, base[i % 30] if i % 3 else base[i % 30] + f" tail{i}", "s") for i in range(120)] + edge_rows()[1:7]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    out = {r.doc_id: r for r in simhash.near_duplicates(table(spark, rows)).collect()}

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        values = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))

    prints = np.array([fingerprint(t) for _, t, _ in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.arange(len(rows))
    while not (label == (new := np.array([label[n].min() for n in near]))).all():
        label = new
    assert [int(out[k].fingerprint, 16) for k in range(len(rows))] == prints.tolist()
    assert [out[k].component_id for k in range(len(rows))] == label.tolist()
    assert sorted(r.doc_id for r in simhash.one_of_each(table(spark, rows)).collect()) == sorted(set(label.tolist()))
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    kept = simhash.one_of_each(table(spark, edge_rows())).collect()
    assert len({r.doc_id for r in kept}) == len(kept)


def test_near_copies_are_those_of_exact_similarity(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([20, 80, 300]))]
        rows.append(" ".join(words))
        for share in (0.01, 0.015, 0.02, 0.025, 0.04, 0.08):
            rows.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words))
    rows += ["", None, "one", "one"]
    sets = [set(zip(*[(t or "").split()[k:] for k in range(5)], strict=False)) or {tuple((t or "").split())} for t in rows]
    label = list(range(len(rows)))
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.9 for i, j in pairs) > 50
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    docs = table(spark, [(k, t, "s") for k, t in enumerate(rows)])
    for rows_ in (near_copies.ROWS, 3):
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, rows=rows_).collect()}
        assert [got[k] for k in range(len(rows))] == label
    import corpus_pipeline

    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted(set(label))
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_are_judged_by_row(spark):
    rng = random.Random(21)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6))
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (None, c, "s"), (None, c + " x", "s"), (7, d, "s"), (7, e, "s"), (7, a, "s"), (8, f, "s"), (8, f, "s"), (9, None, "s"), (9, "", "s")]
    for options in ({}, {"method": near_copies.near_copies}):
        kept = simhash.one_of_each(table(spark, rows), **options).collect()
        assert len(kept) == 7
        assert {(r.doc_id, r.text or "") for r in kept} - {(None, c), (None, c + " x")} == {(1, a), (None, b), (7, d), (7, e), (8, f), (9, "")}


@pytest.mark.parametrize("node_rows", [4096, 20])
def test_gray_index_loses_no_link(spark, node_rows):
    rng = np.random.default_rng(1)
    centers = rng.integers(0, 2**63, 12).astype(np.uint64)
    values = set()
    for _ in range(900):
        v = int(centers[rng.integers(12)])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            v ^= 1 << int(b)
        values.add(v)
    v = np.array(sorted(values, key=lambda x: int(simhash.gray_rank(np.array([x], np.uint64))[0])), np.uint64)
    near = np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3, 1)
    found = set()
    for i, j in simhash.group_pairs(np.zeros(len(v), int), v, 3):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert found == set(zip(*(k.tolist() for k in np.nonzero(near)), strict=True))
    root = simhash.stars(np.arange(len(v)), iter([np.nonzero(near)]))
    merged = np.arange(len(v))
    assert (simhash.stars(merged, simhash.group_pairs(np.zeros(len(v), int), v, 3, merged)) == root).all()
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in simhash.components(simhash.links(df, scratch, 3, None, node_rows), scratch).collect()}
    linked = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
    assert set(got) == set(v.view(np.int64)[linked].tolist())
    assert len(set(got.values())) == len(set(root[linked].tolist()))


def test_components_of_a_long_rising_path(spark):
    path = spark.createDataFrame([(k + 1, k) for k in range(200)], "a long, b long")
    with Scratch(spark) as scratch:
        assert {(r.node, r.root) for r in simhash.components(path, scratch).collect()} == {(k, 0) for k in range(201)}


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_personal_data(spark):
    rng = random.Random(2)
    kinds = [("ab1@.-+ 2%", 0.4), ("0123456789 -.", 0.7), ("+19 ()-.5é😀", 1.0)]
    texts = ["".join(rng.choices(next(a for a, p in kinds if r < p), k=rng.randint(0, 60))) for r in (rng.random() for _ in range(1500))]
    texts += ["1.2.3.4.5.6.7.8", "0001.0.00.255", "256.1.1.1", "a@b.c+d@e.f", "4111 1111 1111 1111", "é😀 a@b.cc é 1.1.1.1 " * 3, "+1 (743) 555-3824", None, "", "1" * 3000, "1 " * 2000, "a." * 700 + "@" + "b." * 9000 + "c", "+1" + "(" * 20000 + "1"]
    out = pii.with_spans(table(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    got = {r.doc_id: r.s for r in out.select("doc_id", pii._listed(pii.KINDS).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [base_spans(t) for t in texts]


def test_sure_patterns_discover_identifiers(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(8)]
    rows = [(i, f'set token = "{k}" now', "s") for i, k in enumerate(keys)] + [(20, "set token = XY-99-Q7Z1 now", "s"), (21, "room number 12345678 is free", "s"), (22, None, "s"), (None, "mail a@b.cc", None), (None, "mail a@b.cc", None)]
    docs = table(spark, rows)
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[20] == "set token = <CONTEXT> now" and out[0] == 'set token = "<CONTEXT>" now'
    assert out[21] == rows[9][1] and out[22] is None and out[None] == "mail <EMAIL>"
    assert pii.redact(docs).count() == len(rows) and pii.redact(docs.limit(0)).count() == 0


def test_clashing_names_travel_along(spark):
    """Every name that an operator uses inside, as a column of the input."""
    names = "score given_score z_text z_id z_h z_hash z_cuts z_new z_spans h row r_id r_h at taken size target position __key __size __bucket c_id c_h text_hash root id key print keys fp first n a b".split()
    rows = [(k, t, "s", *(f"{n}{k}" for n in names)) for k, t in enumerate(["mail a@b.cc now", None, "", "you idiot moron", "plain words"])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *(f"`{n}` string" for n in names)]))
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    scored = toxicity.scored(docs, model)
    assert scored.columns == [*("given_score_" if c == "score" else c for c in docs.columns), "score"]
    assert {r.given_score_ for r in scored.collect()} == {f"score{k}" for k in range(5)}
    for out in (pii.redact(docs), simhash.one_of_each(docs), simhash.one_of_each(docs, method=near_copies.near_copies), mixing.mix(docs), toxicity.without_toxic(docs, model, 2.0)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()}[0] == "mail <EMAIL> now"


def test_patterns_reach_over_long_words(spark):
    """The two words before an identifier can be longer than the characters that are looked at first."""
    long, keys = "x" * 200, [hashlib.sha1(str(i).encode()).hexdigest() for i in range(8)]
    rows = [(i, f"{long} {long} {k} end", "s") for i, k in enumerate(keys)] + [(20, f"{long} {long} AB-12-CD-34 end", "s")]
    assert {r.doc_id: r.text for r in pii.redact(table(spark, rows)).collect()}[20] == f"{long} {long} <CONTEXT> end"


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "Größe", "漢字", "don't  stop", "x1\n"], k=rng.randint(0, 300))), "s") for i in range(150)] + edge_rows()[1:]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)] + [(2000, "a <|endoftext|> b" + "<|endoftext|>" * 200, "s"), (None, "same", None), (None, "same", None)]
    pieces = packing.pack(table(spark, rows), path, 128).toPandas()
    plain = Tokenizer.from_file(path)
    assert 50256 in plain.encode(rows[-3][1], add_special_tokens=False).ids
    for i, text, _ in rows[:-2]:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        own = pieces[pieces.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert (own.length.iloc[1:] == 128).all() and len(own) == -(-len(ids) // 128)
        raw = np.array(ids, "<u4")
        assert own.ids_crc32.tolist() == [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    filled = pieces.sort_values(["sequence_id", "offset"])
    assert (filled.groupby("sequence_id").length.cumsum() - filled.length == filled.offset).all()
    sums = filled.groupby("sequence_id").length.sum()
    assert sums.max() <= 128 and len(sums) <= math.ceil(pieces.length.sum() / 128) * 1.02 + 1
    assert packing.pack(table(spark, []), path).count() == 0


def test_islands_improve_on_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(500, 1100, 3000).tolist()
    first = packing.Packing(sizes, 2048).best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    bins = packing.evolve(sizes, 2048, 0)
    assert Counter(i for b in bins for i in b) == Counter(range(3000))
    assert max(sum(sizes[i] for i in b) for b in bins) <= 2048 and len(bins) <= len(first.bins)


def test_crossover_beats_best_fit():
    """Sizes that fill bins by threes only: best fit, in the order of size, needs more bins than what crossover finds."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        one, two = rng.integers(500, 800, 300), rng.integers(500, 740, 300)
        sizes = np.concatenate([one, two, 2048 - one - two]).tolist()
        first = packing.Packing(sizes, 2048).best_fit(sorted(range(900), key=lambda i: -sizes[i]))
        without = packing.evolve(sizes, 2048, seed, crossovers=0)
        bins = packing.evolve(sizes, 2048, seed)
        assert 300 <= len(bins) < min(len(first.bins), len(without))
        assert sorted(i for b in bins for i in b) == list(range(900)) and max(sum(sizes[i] for i in b) for b in bins) <= 2048


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)] + [(500 + k, t, s) for k, (_, t, s) in enumerate(edge_rows())]
    docs = table(spark, rows)
    out = mixing.plan(docs).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    source = dict((i, s) for i, _, s in rows)
    by = out.assign(s=[source[i] or "" for i in out.doc_id]).groupby("s").agg({"size": "sum", "source_size": "first", "target": "first", "taken": "sum"})
    assert (by["size"] == by.source_size).all() and (abs(by.taken - by.target) <= 1).all()
    assert abs(by.target.sum() - 1.5 * out["size"].sum()) < 1e-6 and (by.target <= 2 * by.source_size).all()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == out.taken.sum()
    assert mixing.plan(table(spark, [])).count() == 0 and mixing.mix(table(spark, [])).count() == 0


def test_licences(spark):
    rows = [(1, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0"), (2, "a/b/c/x.py", "no"), (3, "a/y", None), (None, None, ""), (4, "z", "Copyright. All rights reserved."), (4, "z", "Copyright. All rights reserved."), (5, "a/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "q/r/s.c", "# Released under the MIT license\nint x " + "y " * 50), (7, "q/r/t.c", "mit")]
    files = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, license string")
    out = {r.doc_id: r for r in licenses.scanned(files).collect()}
    assert [(out[k].own_license, out[k].license, out[k].inherited_from) for k in (1, 2, 3, 5)] == [("Apache-2.0", "Apache-2.0", None), (None, "Apache-2.0", "a/b"), (None, "GPL-3.0", "a"), ("GPL-3.0", "GPL-3.0", None)]
    assert out[6].own_license == "MIT" and not out[6].license_file and out[7].license is None and out[None].license is None
    assert licenses.scanned(files).count() == len(rows) and licenses.scanned(files.limit(0)).count() == 0


def test_wrapped_and_unmarked_licences(spark):
    notice = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as
# published by the Free Software Foundation, either version {} of the
# License, or (at your option) any later version.
"""
    bsd = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above notice."""
    texts = [notice.format("Affero ", 3), notice.format("", 3), notice.format("", 2), bsd, licenses.TEMPLATES["BSD-3-Clause"][0], "Some words. All rights reserved."]
    files = spark.createDataFrame([(k, f"{k}/x", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.scanned(files).collect()}
    assert [got[k] for k in range(len(texts))] == ["AGPL-3.0", "GPL-3.0", "GPL-2.0", "BSD-3-Clause", "BSD-3-Clause", "proprietary"]
    every = [(k, v) for k, (name, some) in enumerate(sorted(licenses.TEMPLATES.items())) for v in some]
    own = licenses.scanned(spark.createDataFrame([(n, f"{n}/x", v) for n, (_, v) in enumerate(every)], "doc_id long, path string, text string")).collect()
    names = sorted(licenses.TEMPLATES)
    assert {r.doc_id: r.own_license for r in own} == {n: names[k] for n, (k, _) in enumerate(every)}


def stupid_backoff(rows, order):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, _ in rows]
    counts = Counter(g for w in tokens for n in range(order) for g in zip(*[w[k:] for k in range(n + 1)], strict=False))
    total, out = sum(map(len, tokens)), []
    for (i, _, _), w in zip(rows, tokens, strict=True):
        own = Counter(g for n in range(order) for g in zip(*[w[k:] for k in range(n + 1)], strict=False))

        def score(g, own=own, w=w):
            c = counts[g] - own[g]
            if len(g) == 1:
                return math.log(max(c, 1) / max(1, total - len(w)))
            return math.log(c / max(1, counts[g[:-1]] - own[g[:-1]])) if c else math.log(0.4) + score(g[1:])

        out.append((i, len(w), sum(score(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))) / len(w) if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stupid_backoff(spark, order):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("the a cat dog Runs far".split(), k=rng.randint(0, 40))), "s") for i in range(60)] + [(100 + k, t, s) for k, (_, t, s) in enumerate(edge_rows())]
    got = {r.doc_id: r for r in lm.scored(table(spark, rows), order).collect()}
    for i, n, s in stupid_backoff(rows, order):
        assert got[i].n_words == n and (s is None and got[i].score is None or abs(got[i].score - s) < 1e-9)
    assert lm.scored(table(spark, [])).count() == 0
