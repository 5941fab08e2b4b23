"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
# Sums over three-word runs of all texts take DuckDB long; one query stands for the three.
SLOW = {"keyword_hit_counts", "keyword_frequency", "keyword_spans"}


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_keyset_pages_cover_all_rows_once(spark):
    from tessera.plans.feed import page_after

    rows = spark.createDataFrame([(i % 3, i) for i in range(25)], "a int, b int")
    seen, cursor = [], None
    while True:
        page = page_after(rows, [("a", True), ("b", False)], cursor, 10).orderBy("rank").collect()
        seen += [(r.a, r.b) for r in page]
        if not page[0].has_more:
            break
        cursor = {"a": page[-1].a, "b": page[-1].b}
    assert seen == sorted(((i % 3, i) for i in range(25)), key=lambda x: (-x[0], x[1]))


def test_cosine_pairs_of_all_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = {k: rng.normal(size=8).astype(np.float32).tolist() for k in (0, 3, 499, *range(500, 530), 1999, 40_000)}
    rows = [(k, v, k % 2) for k, v in vectors.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = {k: np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) for k, v in vectors.items()}
    want = {(a, b): round(float(unit[a] @ unit[b]), 3) for a in vectors for b in vectors if a < b and a % 2 == b % 2}
    want = {k: v for k, v in want.items() if v >= 0.3}
    assert any(a >= 500 for a, _ in want)
    assert {(r.a, r.b): r.sim for r in registry.QUERIES["cosine_pairs_blocked"](spark, str(tmp_path)).collect()} == want
    best = {a: max(((v, -b) for (x, b), v in want.items() if x == a)) for a, _ in want}
    assert {r.a: (r.sim, -r.candidate) for r in registry.QUERIES["best_candidate"](spark, str(tmp_path)).collect()} == best


def test_pair_decisions_see_all_words(spark, tmp_path):
    from itertools import product

    words = lambda first: ["".join((first, *x)) for x in product("bcdfghjklmnpqrstv", repeat=2)][:280]
    texts = [" ".join(words("a") + words("z")), " ".join(words("e") + words("z"))]  # alphabetically first 200: none shared
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.95, 0.3122499], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in registry.QUERIES["guarded_pair_decisions"](spark, str(tmp_path)).collect()] == [(0, 1, 0.95, "merge")]


def test_frame_lines_are_merged_by_their_whole_texts(spark, tmp_path):
    same = "the same beginning of two lines that is longer than sixty characters "
    long = " ".join(f"{k} and so on" for k in range(40))
    turns = [(1, 0, "user", same + "ends here"), (1, 1, "user", same + "but the other line goes on for quite some while"), (2, 0, "user", long), (2, 1, "user", long + "!")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = registry.QUERIES["frame_line_merge"](spark, str(tmp_path)).collect()
    assert {r.text for r in rows if r.frame == 1} == {t for c, _, _, t in turns if c == 1}
    assert [r.text for r in rows if r.frame == 2] == [long]


def test_token_pairs_of_lines_of_any_length(spark, tmp_path):
    from itertools import combinations

    long = " ".join(f"word{k}" for k in range(300))
    lines = ["a b c d", "A b c e", "a b c d e", "x y z", "one line of some forty characters in all", "one line of some forty letters in all", long, long.replace("word7 ", "other "), long.replace("word", "else")]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(lines + lines[:2])] + [(90, "\n".join(lines), "en"), (91, "a b c d", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {x.lower(): set(x.lower().split()) for x in lines if len(set(x.split())) >= 4}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in combinations(sorted(sets), 2)}
    got = {(r.a, r.b): r.jaccard for r in registry.QUERIES["token_jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.5} and len(got) >= 4


def _same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}/*.parquet'")
    got, want = registry.QUERIES[name](spark, folder), con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(columns).collect())))
    assert rows and rows == sorted(map(repr, want.select(*columns).fetchall()))


# Words beside letters that are not ASCII, odd spaces, ends and cases, digits and numbers of the Arabic script.
ODD_TEXTS = (
    "esñó adoja noítaga del", "adñno ó", "never", "refuſed", "failed\u000bto", "failed\t to", "can’t", "not_", "ınot", "sİx and two", "١٢ and ۵ five", "پانچ ۵ 5", "یہ نہیں", "نہ ", "نہ\u000b", "<unK>", "</ſ>",
    "  no　", "\u000bab\u000b", "ΑΣ", "ας", "ab éno cd ñno ef óno gh", "1,000.5 thousand", "", " ", "x" * 50, "\U0001f926 not", "éno",
)


def test_script_and_negation_of_odd_texts(spark, tmp_path):
    rows = [(0, k, "user", t) for k, t in enumerate((*ODD_TEXTS, None))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    _same_as_sql(spark, "script_and_negation", str(tmp_path))


def test_translation_quality_of_odd_texts(spark, tmp_path):
    texts = (*ODD_TEXTS, None)
    pairs = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    rows = [(k, turn, role, t) for k, a, b in pairs for turn, role, t in ((k % 5 * 2, "user", a), (k % 5 * 2 + 1, "assistant", b))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    _same_as_sql(spark, "translation_quality", str(tmp_path))


def test_benchmark_items_anywhere_in_a_text(spark, tmp_path):
    items = ["One.\nTwo three four five six", "a b", "ab cd ef", "one", "", " lead and trail ", "w1 w2 w3 w4", "x\ny z", "same words here twice", "same words here twice", "Ünï çödé wörds ïn ït", None]
    texts = [*items, "so. One.\nTwo three four five sixth", "One. Two three four five six", "tab cd eff", "xw1 w2 w3 w45", "w1 w2\nw3 w4", "no lead and trail, but  lead and trail  too", "bone", "a\nb", "ax\ny zz", "not the same words here twice over", "same words here twice"]
    ids = [*range(len(texts) - 2), 3, None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    _same_as_sql(spark, "benchmark_containment", str(tmp_path))


def test_packed_token_pairs_lose_none(spark, tmp_path, monkeypatch):
    from tessera.operators import similar_lines

    monkeypatch.setattr(similar_lines, "PART_ENTRIES", 300)  # several parts
    monkeypatch.setattr(similar_lines, "HELD", 50)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    lines = [" ".join(rng.choice(words[: rng.integers(12, 400)], rng.integers(3, 40))) for _ in range(150)]
    lines += [" ".join(w for w in x.split() if rng.random() < keep) + " new" for x in lines for keep in (0.95, 0.75, 0.55)]
    lines += [" Trimmed by odd spaces　", "trimmed by odd spaces", "ΑΣ β γ δ", "ας β γ δ", "x y z"]
    rows = [(k, "\n".join(lines[k::40]), "en" if k % 3 else "de") for k in range(40)] + [(50, None, "en"), (51, "\n".join(lines[:9]), None), (52, "\n".join(lines[::40]), "en"), (53, "", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    _same_as_sql(spark, "token_jaccard_pairs", str(tmp_path))
