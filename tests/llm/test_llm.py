"""Small fixtures and brute force for the operators of the llm subpackage."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontaminate, host_rules, line_spread, main_text, near_dedup, notice_scan, perspectives, piece_lattice, quality_gam, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, score string, unit string"


def docs(spark, texts, sources=None):
    """Documents, with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


WORDS = [f"w{k}" for k in range(400)]
EDGE = [None, "", "  \n\n ", "one", "a b c d", "same same", "same same", "x " * 30_000, "\n".join(["line of text here"] * 5)]


def passage(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_edges_and_empty_tables(spark):
    some, none = docs(spark, EDGE), docs(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too few words"), (4, passage(5, 30))], "item_id long, text string")
    for run in (
        sharding.shard,
        near_dedup.near_duplicates,
        near_dedup.near_dedup,
        line_spread.line_spread,
        host_rules.host_rules,
        notice_scan.notice_scan,
        piece_lattice.encode,
        lambda d: quality_gam.quality_scores(d, labels),
        lambda d: decontaminate.decontaminate(d, bench),
    ):
        n = run(some).count()
        assert n == len(EDGE) or run is near_dedup.near_dedup and n < len(EDGE)
        assert run(none).count() == 0
    assert decontaminate.leaks(some, bench).count() == 0
    assert decontaminate.decontaminate(some, bench.limit(0)).count() == len(EDGE)
    assert quality_gam.quality_scores(some, labels.limit(0)).count() == len(EDGE)


def test_shards_are_even_and_gapless(spark):
    texts = ["copy"] * 60 + [f"shared line of thirty characters {i % 5}\nown {i}" for i in range(100)] + [None]
    rows = sharding.shard(docs(spark, texts), shards=7).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    by = {r.doc_id: r for r in rows}
    assert (by[160].size, by[160].text_crc32, by[0].size) == (16, 0, 20)


def test_leaks_exact_and_edited(spark):
    items = [(k, passage(k, 60)) for k in range(5)]
    words = items[1][1].split()
    edited = " ".join([*words[:30], "changed", *words[31:]])  # 51 of 61 shingles: 0.836
    broken = " ".join(w if k % 6 else "z" for k, w in enumerate(words))
    texts = [f"Intro. {items[0][1].upper()}!! End", f"{passage(90, 50)} {edited} {passage(91, 50)}", broken, passage(92, 200), items[2][1], None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert set(found) == {(0, 0), (1, 1), (4, 2)}
    assert found[0, 0] == 1.0 and 0.8 <= found[1, 1] < 1
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()) == [2, 3, 5]


def _word_list(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def _leaks_by_brute_force(texts, items, threshold=0.8):
    """Every window of every item's size at every start, also cut at the ends; weights as the module has them."""
    sh = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    of = {k: Counter(sh(_word_list(t))) for k, t in items.items()}
    of = {k: c for k, c in of.items() if c}
    df = Counter(x for c in of.values() for x in c)
    weight = lambda x: round(1000 * math.log1p(len(of) / df.get(x, 1)))
    total = {k: sum(n * weight(x) for x, n in c.items()) for k, c in of.items()}
    found = set()
    for d, text in texts.items():
        s = sh(_word_list(text))
        where = {x for x in s if x in df}
        for k, c in of.items():
            if sum(weight(x) * min(n, s.count(x)) for x, n in c.items() if x in where) < threshold * total[k]:
                continue
            n = sum(c.values())
            for start in range(1 - n, len(s)):
                window = Counter(s[max(0, start) : start + n])
                both = sum(min(n, c[x]) * weight(x) for x, n in window.items() if x in c)
                if both >= threshold * (total[k] + sum(n * weight(x) for x, n in window.items()) - both):
                    found.add((d, k))
                    break
    return found


def test_leaks_against_all_windows(spark):
    rng = np.random.default_rng(11)
    items = {k: passage(300 + k, int(rng.integers(60, 110))) for k in range(12)}
    texts = {}
    for k in range(90):
        words = items[k % 12].split()
        for at in rng.choice(len(words), int(rng.integers(0, 3)), replace=False):
            words[at] = "changed"
        if k % 3 == 1:  # halves in swapped order
            words = words[len(words) // 2 :] + words[: len(words) // 2]
        if k % 3 == 2:
            words.insert(len(words) // 2, "a few words put in between")
        texts[k] = f"{passage(400 + k, 40)} {' '.join(words)} {passage(500 + k, 40)}" if k % 5 else " ".join(words)
    want = _leaks_by_brute_force(texts, items)
    frame = docs(spark, [texts[k] for k in range(90)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert len(want) > 30 and got <= want and len(got) >= 0.97 * len(want)


def test_leaks_of_a_real_table_against_all_windows(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    items = dict(spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    want = _leaks_by_brute_force(texts, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.op2_decontaminate(spark, sf).collect()}
    assert want and len(got & want) >= 0.9 * len(want) and got <= want


def test_leaks_without_doc_id_and_repeated_rows(spark):
    rows = [(None, passage(1, 60)), (None, passage(2, 60)), (None, passage(70, 60)), (3, passage(1, 60)), (3, passage(1, 60)), (4, "b " * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage(1, 60)), (2, passage(2, 60)), (2, passage(2, 60))], "item_id long, text string")
    assert sorted((r.doc_id or -1, r.item_id) for r in decontaminate.leaks(frame, bench).collect()) == [(-1, 1), (-1, 2), (3, 1)]
    assert sorted(r.text for r in decontaminate.decontaminate(frame, bench).collect()) == sorted([passage(70, 60), "b " * 40])


def test_multi_index_finds_all_within_radius(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(-(1 << 62), 1 << 62, 20)
    probes = []
    for k, p in enumerate(prints):
        for flips in (0, 5, 15, 19, 20):
            v = int(p) & 0xFFFFFFFFFFFFFFFF
            for b in rng.choice(64, flips, replace=False):
                v ^= 1 << int(b)
            probes.append((k, False, flips, 0, 5, v - (1 << 64) if v >> 63 else v, 1))
    windows = spark.createDataFrame(probes, "doc_id long, no_id boolean, whole long, start int, n_words int, print long, total long")
    items = spark.createDataFrame([(k, int(p), 1) for k, p in enumerate(prints)], "item_id long, print long, total long")
    got = {(r.doc_id, r.whole, r.item_id) for r in decontaminate.within_radius(windows, items).collect()}
    want = {(a, f, k) for a, _, f, _, _, v, _ in probes for k, p in enumerate(prints) if ((v ^ int(p)) & 0xFFFFFFFFFFFFFFFF).bit_count() <= decontaminate.RADIUS}
    assert got == want


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|assistant|>"), (1, 2, "bo", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (None, 1, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.speaker): r for r in perspectives.perspectives(turns).collect()}
    assert set(out) == {(1, "ann"), (1, "bo"), (None, "unknown")}
    ann = out[1, "ann"]
    spans = [tuple(map(int, x.split("-"))) for x in ann.mask.split(",")]
    assert [ann.text[a:b] for a, b in spans] == ["hi < |assistant|><|end|>", "bye<|end|>"]
    assert "<|user name=bo|>\n<|end|>\n" in ann.text and ann.text.startswith("<|system|>\nbe kind<|end|>\n")
    chunks = perspectives.perspectives(turns.where("conv_id = 1"), chunk_turns=2).where("speaker = 'ann'").orderBy("chunk").collect()
    assert "".join(c.text for c in chunks) == ann.text and chunks[1].offset == len(chunks[0].text)


def test_perspectives_of_long_dialogues_ties_and_empty_tables(spark, tmp_path):
    """Chunks by turn numbers and by turns, against the SQL on rows that the tables don't hold."""
    import duckdb

    rng = np.random.default_rng(6)
    rows = [(7, k, str(rng.choice(["ann", "bo", "cy"])), f"t{k} <| x") for k in range(1400)]  # three chunks
    rows += [(8, 5, f"p{k % 2}", f"tie {k}") for k in range(1100)] + [(8, 5, "p1", "tie 1")] * 3 + [(8, None, None, None), (8, 2000, "late", "")]
    rows += [(9, 0, "system", "only"), (None, 1, "a", "x"), (None, 1, "a", "x"), (10, 0, "a", "same"), (10, 0, "a", "same")]
    turns = spark.createDataFrame([(*r, "c", 1, "p", 2) for r in rows], "conv_id long, turn long, role string, text string, chunk string, part int, speaker string, n int")
    out = perspectives.perspectives(turns)
    con = duckdb.connect()
    frame = turns.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    want = {tuple(r) for r in con.sql(f"select conv_id, speaker, chunk, n_turns, n_masked, text, mask, \"offset\" from ({perspectives.SQL})").fetchall()}
    got = {tuple(r) for r in out.select("conv_id", "speaker", "chunk", "n_turns", "n_masked", "text", "mask", "offset").collect()}
    assert got == want and max(r[3] for r in got) <= 512 and {r[2] for r in got if r[0] == 8} == {0, 1, 2, 3}
    assert perspectives.perspectives(turns.limit(0)).count() == 0


def _links(texts):
    s = [near_dedup.shingles(near_dedup.words(t)) for t in texts]
    df = np.zeros((2, 1 << near_dedup.DF_BITS), np.int64)
    for h, _ in s:
        for table, at in zip(df, near_dedup.buckets(h), strict=True):
            np.add.at(table, at, 1)
    idf = near_dedup.idf_tables(df, len(texts))
    w = [(h, near_dedup.weigh(h, tf, idf)) for h, tf in s]
    return {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if near_dedup.similarity(w[a], w[b]) >= near_dedup.THRESHOLD}


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates_against_brute_force(spark, small):
    rng = np.random.default_rng(7)
    texts = []
    for k in range(12):
        base = passage(k, 120).split()
        for _ in range(6):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(0, 5)), replace=False):
                copy[at] = f"e{rng.integers(1_000_000)}"
            texts.append(" ".join(copy))
    texts += [passage(50, 40) + " " + passage(200 + k, 60) for k in range(30)] + ["", None, "three words only", "three words only"]
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in sorted(_links(texts)):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_dedup.NearDuplicates(docs(spark, texts), small=small).members().collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_near_duplicates_of_a_real_table_against_brute_force(spark):
    """Every pair of sf0.01 whose weighted Jaccard reaches the threshold is in one group: recall of links, near the threshold too."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    s = [near_dedup.shingles(near_dedup.words(t)) for t in rows.text]
    df = np.zeros((2, 1 << near_dedup.DF_BITS), np.int64)
    for h, _ in s:
        for table, at in zip(df, near_dedup.buckets(h), strict=True):
            np.add.at(table, at, 1)
    idf = near_dedup.idf_tables(df, len(rows))
    w = [(h, near_dedup.weigh(h, tf, idf)) for h, tf in s]
    total = [x[1].sum() for x in w]
    holders = {}
    for k, (h, _) in enumerate(w):
        for x in h.tolist():
            holders.setdefault(x, []).append(k)
    pairs = {p for ks in holders.values() for p in itertools.combinations(ks, 2)}
    pairs = {(a, b) for a, b in pairs if min(total[a], total[b]) >= near_dedup.THRESHOLD * max(total[a], total[b])}
    links = {(a, b): v for a, b in pairs if (v := near_dedup.similarity(w[a], w[b])) >= near_dedup.THRESHOLD}
    group = dict(near_dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "class_id").collect())
    caught = {p: group[int(rows.doc_id[p[0]])] == group[int(rows.doc_id[p[1]])] for p in links}
    close = [ok for p, ok in caught.items() if links[p] < 0.85]
    assert len(links) > 50 and np.mean(list(caught.values())) >= 0.98 and (not close or np.mean(close) >= 0.9)


def test_weights_do_not_depend_on_the_size_of_the_corpus():
    rng = np.random.default_rng(5)
    common, idf = rng.integers(0, 1 << 63, 3).astype(np.uint64), []
    for n in (2_000, 200_000):  # documents of 100 rare shingles each; each of the common ones in a fifth of them
        df = np.zeros((2, 1 << near_dedup.DF_BITS), np.int64)
        for table, at in zip(df, near_dedup.buckets(rng.integers(0, 1 << 63, 100 * n).astype(np.uint64)), strict=True):
            table += np.bincount(at, minlength=len(table))
        for table, at in zip(df, near_dedup.buckets(common), strict=True):
            np.add.at(table, at, n // 5)
        idf.append(near_dedup.weigh(np.concatenate([common, rng.integers(0, 1 << 63, 50).astype(np.uint64)]), np.ones(53), near_dedup.idf_tables(df, n)))
    assert np.allclose(idf[0][:3], 1 + np.log(5), atol=0.1) and np.allclose(idf[0][:3], idf[1][:3], atol=0.1)
    assert (idf[0][3:] > 5.4).all() and (idf[1][3:] > 5.4).all()


def test_words_of_scripts_without_spaces():
    a = "".join(chr(0x4E00 + k) for k in range(400))
    x, y = (near_dedup.shingles(near_dedup.words(t)) for t in (a, a[:200] + "\u9fa0" + a[201:]))
    assert len(x[0]) == 396 and near_dedup.similarity(x, y) > 0.9


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    a, b = h[:300], h[60:360]
    hits = []
    for k in range(40):
        salt = near_dedup._mix(np.array([k + 1], np.uint64))[0]
        x, y = (near_dedup._mix(v ^ salt) for v in (a, b))
        hits.append((near_dedup.sampler().bands(x, np.ones(len(x)))[0] == near_dedup.sampler().bands(y, np.ones(len(y)))[0]).mean())
    assert abs(np.mean(hits) - (240 / 360) ** near_dedup.ROWS) < 0.04


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (5, 4), (20, 30)]
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 20: 20, 30: 20}


def test_components_of_a_long_path_and_of_further_links(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(2000, 2000)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    want = {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)} | {2000: 2000}
    assert {r.id: r.root for r in near_dedup.components(frame(edges)).collect()} == want
    some = near_dedup.components(frame(edges[::2]))
    assert {r.id: r.root for r in near_dedup.joined(some, frame(edges[1::2])).collect()} == want
    assert near_dedup.components(frame([])).count() == 0


def test_lines_by_spread(spark):
    texts = [f"own {k}\n shared by all\nshared by some {k % 2}\n\nend {k}" for k in range(24)] + [None]
    out = {r.doc_id: r for r in line_spread.line_spread(docs(spark, texts, [f"s{k}" for k in range(25)]), min_sites=13).collect()}
    assert out[0].text == texts[0] and out[24].text is None
    assert all(out[k].text == f"own {k}\nshared by some {k % 2}\n\nend {k}" and out[k].n_removed == 1 for k in range(1, 24))


def test_long_lines_need_two_sites(spark):
    long, own = passage(61, 60), lambda k: "\n".join(passage(900 + 10 * k + j, 45) for j in range(3))
    texts = [f"{own(0)}\n{long}", f"{own(1)}\n  {long}", f"{long}\nshort", long, f"{own(4)}\n{passage(62, 60)}", f"{own(5)}\n{passage(62, 60)}"]
    out = {r.doc_id: r for r in line_spread.line_spread(docs(spark, texts, ["a", "b", "c", "d", "e", "e"])).collect()}
    assert out[1].text == own(1) and out[1].n_removed == 1
    assert all(out[k].text == texts[k] and out[k].n_removed == 0 for k in (0, 2, 3, 4, 5))  # the first; copies; one site only


def test_lines_without_doc_ids_ties_and_clashing_names(spark):
    rows = [(None, f"own {k}\nshared", f"s{k}", 7, 8, 9) for k in range(6)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, pos int, first int")
    out = line_spread.line_spread(frame, min_sites=5).collect()
    assert len(out) == 12 and {r.n_lines for r in out} == {2} and {r.first for r in out} == {9}
    assert sorted(r.text for r in out if "shared" in r.text) == [x for x in sorted({r.text for r in out if "shared" in r.text}) for _ in "ab"]
    assert len({r.text for r in out if "shared" in r.text}) == 1


def test_a_text_of_many_lines(spark):
    frame = docs(spark, ["\n".join(["menu"] * 30_000 + [f"own {k}"]) for k in range(12)], [f"s{k}" for k in range(12)])
    out = {r.doc_id: r for r in line_spread.line_spread(frame).collect()}
    assert out[3].text == "own 3" and out[3].n_removed == 30_000 and out[0].n_removed == 0


def test_host_rules(spark):
    good = passage(1, 40)
    texts = ["short"] * 20 + [good] * 20 + [good, good, None, "short"]
    sources = ["bad"] * 20 + ["fine"] * 20 + ["bad", "fine", None, None]
    out = {r.doc_id: r for r in host_rules.host_rules(docs(spark, texts, sources)).collect()}
    assert not out[40].kept and not out[40].base_failed and out[41].kept and not out[42].kept and out[43].host_rate is None
    assert host_rules.measure("a b c d e x a b c d e\n#|\n#|")[1:] == (15, 4, 1, 10)


def test_notices():
    n = lambda t: notice_scan.scan(t)
    assert n("Under the MIT License and the mit-license.")[:6] == (8, 2, 2, 6, "mit", "mit")
    assert n(None)[:7] == (0, 0, None, None, "", "", 0.0)
    typo = n("x Permission is herebye grnted, free of charge, to any person obtaning a copy y")
    assert typo[5] == "mit" and typo[8][0]["edits"] == 3 and typo[8][0]["first_word"] == 1
    notice, edits = notice_scan.NOTICES[0][0], notice_scan.NOTICES[0][2]
    rng = np.random.default_rng(2)
    for _ in range(60):  # whatever the places of the edits, the pieces find it
        s = list(notice)
        for at in rng.choice(len(s), edits, replace=False):
            s[at] = "q"
        assert any(x["label"] == "mit" for x in n("w " + "".join(s) + " w")[8])


def test_notices_closer_than_their_edits_are_told_apart():
    labels = lambda t: notice_scan.scan(t)[5]
    for kind in ("sa", "nc", "nd", "nc-sa", "nc-nd"):
        assert labels(f"Text licensed under CC BY-{kind.upper()} by us") == f"cc-by-{kind}"
        assert labels(f"Text licensd under CC-BY-{kind.upper()} by us") == f"cc-by-{kind}"
    assert labels("licensed under CC BY 4.0") == "cc-by"
    bsd = "Copyright. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted"
    assert labels(bsd) == "bsd" and {x["label"] for x in notice_scan.scan(bsd)[8]} == {"bsd", "proprietary"}
    assert labels("All rights reserved.") == "proprietary"


def test_notices_of_a_real_table_against_brute_force(spark):
    import regex

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(rows.select("doc_id", "text").collect())
    phrases = {tuple(k.split()): v for k, v in notice_scan.BASE.items()}
    for r in notice_scan.op7_notice_scan(spark, "/root/testdata/sf0.01").collect():
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or ""))
        places = [(k, label) for k in range(len(words)) for p, label in phrases.items() if tuple(words[k : k + len(p)]) == p]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        text = f" {' '.join(words)} ".encode()
        found = {label for notice, label, edits in notice_scan.NOTICES if regex.search(b"(?<= )(?:" + notice.encode() + b"){e<=%d}(?= )" % edits, text)}
        assert {x.label for x in r.spans} <= found and bool(r.spans) == bool(found)


def test_best_region_against_all_regions():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.integers(-5, 5, 12).tolist()
        a, b = main_text.best_region(s)
        assert sum(s[a:b]) == max(0, max(sum(s[i:j]) for i in range(12) for j in range(i, 13)))


def test_main_text():
    page = """<html><head><title>T</title></head><body><header><a>Top</a></header><nav><ul><li><a>Home</a></li></ul></nav>
    <article><header><h1>Caf&eacute; &amp; bar</h1></header><p>First <i>words</i>
    here.<p>Second one.<div class="ad">Buy!</div><script>x<y</script><ul><li>a point</li></ul><form>Mail</form><p>End</article>
    <section class="comments"><p>I liked it very much, thank you</p></section><footer>(c)</footer></body></html>"""
    assert main_text.main_text(page) == "Café & bar\n\nFirst words here.\n\nSecond one.\n\na point\n\nEnd"
    assert main_text.main_text(None) == "" and main_text.main_text("<nav><a>Home</a></nav>") == ""


def test_main_text_without_telling_elements_and_on_deep_or_broken_pages():
    paragraphs = [f"Paragraph {k} of a text that goes on for a good dozen of words or so." for k in range(4)]
    links = "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Title</h1>{''.join(f'<p>{x}</p>' for x in paragraphs)}</div><table><tr><td><a>One</a> <a>Two</a> <a>Three</a></td></tr></table></body>"
    assert main_text.main_text(page) == "\n\n".join(["Title", *paragraphs])
    deep = "<div>" * 20_000 + "<article><p>Some words</p><b>and more" + "</div>" * 20_000
    assert main_text.main_text(deep) == "Some words\n\nand more"
    noisy = "<article><p>First part here.</p><div class=ad><ul>" + links + "</ul></div><p>End.</p></article>"
    assert main_text.main_text(noisy) == "First part here.\n\nEnd."
    assert main_text.main_text("<p") == "<p" or main_text.main_text("<p") == ""
    assert main_text.main_text("<article><p style='display:none'>no</p><p>yes &lt;b&gt;</p>") == "yes <b>"


def test_main_text_on_labelled_pages_that_the_weights_have_not_seen():
    pages, wanted, missed, wrong = main_text.labelled_pages(700)[300:], 0, 0, 0
    for page in pages:
        text = main_text.main_text("<html><body>" + "".join(p.replace("word", "good" if good else "evil") for p, good in page))
        of_page = sum(p.count("word") for p, good in page if good)
        wanted, missed, wrong = wanted + of_page, missed + of_page - text.count("good"), wrong + text.count("evil")
    assert missed < 0.1 * wanted and wrong < 0.01 * wanted


def test_main_text_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "y"), (3, "v", "<p>plain words in a page</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in main_text.extract(pages).collect()) == [(0, "", 0), (1, "", 0), (1, "", 0), (3, "plain words in a page", 21)]
    assert main_text.extract(pages.limit(0)).count() == 0


def test_gam_learns_an_interaction_and_scores_in_bins():
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(quality_gam.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    assert {(0, 1)} <= {p[:2] for p in model.pairs}


def test_gam_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_gam.op9_quality_gam(spark, sf).join(labels, "doc_id").where("held_out").select("predicted", "quality").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93


def _all_segmentations(lattice, spelt):
    ends = lattice.arcs(spelt)

    def go(b):
        if b == 0:
            yield 0, ()
        for a, ids, s in ends[b]:
            for score, path in go(a):
                yield score + s, path + ids

    return sorted((s for s, _ in go(len(spelt))), reverse=True)


def test_nbest_against_all_segmentations():
    lattice = piece_lattice.lattice()
    for text in ("the cat,", "éron x", "a  b", "漢c", "e.g ..", "▁x", "\nab"):
        spelt = (" " + text).replace("▁", piece_lattice._STAND_IN).replace(" ", "▁")
        best = next(lattice.encode([text]))
        assert [s for s, _ in best] == _all_segmentations(lattice, spelt)[: lattice.nbest]
        assert all(lattice.decode(ids.tolist()) == text for _, ids in best)
        assert [s for s, _ in lattice.search(spelt)] == [s for s, _ in best]


@pytest.mark.parametrize("text", ["z" * 5_000, "ha" * 2_500, "ACGT" * 600])
def test_long_runs_are_searched_like_short_ones(text):
    lattice = piece_lattice.lattice()
    found = next(lattice.encode([text]))
    spelt = (" " + text).replace(" ", "▁")
    best = lattice.search(spelt)
    assert found[0][0] == best[0][0] and lattice.decode(found[0][1].tolist()) == text
    parts = lattice.parts(text)
    assert sum(lattice.known[p][0] for p in parts) == best[0][0]


def test_encode_round_trip(spark):
    texts = [*EDGE, "Ünï ▁ 漢字 \x00 😀 tail  ", "z" * 500]
    out = piece_lattice.encode(docs(spark, texts))
    assert all(r.round_trip for r in out.collect())
    back = {r.doc_id: r.text for r in piece_lattice.decode(out).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts))


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert 100 < len(out) < 200 and out.round_trip.all() and math.isfinite(out.score.sum())


def _folder(spark, at, texts):
    """A folder of tables whose documents have nulls in every column, repeated rows and a further column."""
    rows = [(k, t, "en", f"s{k % 4}", len(t or ""), "x") for k, t in enumerate(texts)]
    rows += [(None, passage(3, 80), None, None, None, None), (None, None, None, None, None, None), *rows[:3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 2), 0) for k in range(len(texts))] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage(60, 60)), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_stages_on_nulls_ties_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    good = [passage(k, 90) for k in range(4)]
    texts = [*EDGE, *good, good[0], f"{passage(80, 20)} {passage(60, 60)} {passage(81, 20)}"]
    at = _folder(spark, tmp_path / "some", texts)
    docs_ = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "benchmark", "pieces"]
    n = len(texts) + 5
    assert stages["quality"](spark, docs_, at).count() <= n
    assert stages["lines"](spark, docs_, at).count() == n
    near = stages["near_duplicates"](spark, docs_, at)
    ids = [r.doc_id for r in near.collect()]
    assert ids.count(None) == 2 and len(set(ids)) == len(ids) - 1 and len(EDGE) + 4 not in ids  # copies go, one row of each id stays
    left = {r.doc_id for r in stages["benchmark"](spark, docs_, at).collect()}
    assert left == {*range(len(texts) - 1), None}
    pieces = stages["pieces"](spark, docs_, at)
    assert pieces.count() == n and pieces.where("not round_trip").isEmpty()
    none = docs_.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, at)
        assert out.count() == 0 and (name == "pieces" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"])


def test_shards_are_linked_by_every_shared_line(spark):
    texts = ["\n".join([f"a line of group {k % 4} that others have", f"another line of group {k % 4} as well", *(f"own line {j} of the text {k} alone" for j in range(40))]) for k in range(16)]
    rows = sharding._described(docs(spark, texts), "text").selectExpr("doc_id as unit", "bigint(1) as n", "hubs")
    assert sharding.shared_hubs(rows).where("parts <> 1 or part <> 0").isEmpty()
    links = [(r.unit, r.hub) for r in sharding.shared_hubs(rows).collect()]
    assert len(links) == len(set(links)) == 32 and len({h for _, h in links}) == 8
    assert Counter(u for u, _ in links) == {k: 2 for k in range(16)}


def test_propagation_cuts_fewer_links_than_the_start_and_splits_hot_hubs(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "HUB_PART", 7)
    texts = ["\n".join([f"line {j} of group {k % 24}" for j in range(4)] + ["a line that all have", f"own line of {k}"]) for k in range(480)]
    rows = sharding._described(docs(spark, texts), "text").selectExpr("doc_id as unit", "bigint(1) as n", "hubs")
    edges = sharding.shared_hubs(rows)
    assert edges.where("parts > 1").select("part").distinct().count() > 1
    start = rows.select("unit", F.pmod(F.xxhash64("unit"), F.lit(6)).cast("int").alias("label"))
    labels = sharding.propagate(rows.select("unit", "n"), edges, 6)
    sizes = [r["count"] for r in labels.groupBy("label").count().collect()]
    (before, links), (after, _) = sharding.cut_edges(edges, start), sharding.cut_edges(edges, labels)
    assert links == 480 * 5 and after < 0.6 * before and len(sizes) == 6 and max(sizes) <= 1.5 * 80


def test_sharding_sizes_and_sums_against_sql(spark):
    import duckdb
    from zlib import crc32

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.op1_sharding(spark, sf).collect()}
    want = duckdb.sql(f"select doc_id, strlen(coalesce(text, '')) + 16, coalesce(text, '') from '{sf}/documents.parquet'").fetchall()
    assert got == {a: (b, crc32(t.encode())) for a, b, t in want}
