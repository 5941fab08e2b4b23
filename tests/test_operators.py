import json

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import stories as S
from tessera.operators.keywords import classify, keyword_hits
from tessera.sources import manifests as M


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_normalisers(spark):
    assert _one(spark, T.match_normalised(F.col("t")), t="  أهلاً   WORLD ") == "اهلا world"
    assert _one(spark, T.exact_key(F.col("t")), t="Fire -- at 3,400!") == "fire at 3 400"
    assert _one(spark, T.numbers(F.col("t")), t="۵ of 12") == ["12", "5"]
    assert spark.createDataFrame([("Straße ﬁn",), (None,)], "t string").select(T.nfkc_match_normalised("t").alias("x")).collect()[0].x == "strasse fin"
    assert _one(spark, T.script_profile(F.col("t")), t="abc خبر") == "mixed"


def test_sentences_keep_abbreviations_and_numbers():
    assert T.split_sentences("Dr. Khan paid 3.5 m. Then? (Yes.) rest") == (["Dr. Khan paid 3.5 m.", "Then?", "(Yes.)"], "rest")


def test_overlap_merge(spark):
    assert T.merge_overlap("a b c".split(), "b c d".split()) == ("a b c d".split(), "append")
    assert T.merge_overlap("b c".split(), "a b".split()) == ("a b c".split(), "prepend")
    assert T.merge_overlap(["a"], ["z"]) == (["a"], "no_overlap")
    assert _one(spark, T.overlap(F.split("a", " "), F.split("b", " ")), a="a b c", b="b c d") == 2


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(F.round(V.cosine(F.col("a"), F.col("b")), 4).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("s"), V.l2_normalised(F.col("z")).alias("n")).first()
    assert (r.c, r.s, r.n) == (0.7071, 0.0, [0.0, 0.0])


TAXONOMY = [("fire", "blaze", False, [], [], "high"), ("sport", "match", True, ["goal"], ["box"], "normal"), ("sport", "match day", True, [], [], "critical"), ("law", "ruling of the supreme court of appeal", False, [], [], "normal"), ("place", "u.s.", False, [], [], "normal")]
TAXONOMY_COLUMNS = "category string, term string, requires_context boolean, context_terms array<string>, excluded_terms array<string>, priority string"


def test_keywords_need_context(spark):
    tax = spark.createDataFrame(TAXONOMY, TAXONOMY_COLUMNS)
    docs = spark.createDataFrame([(1, "A Blaze broke out"), (2, "the match"), (3, "match day"), (4, "the match goal"), (5, "match goal box"), (6, "blazer"), (7, None), (8, "the match stadium")], "doc_id long, text string")
    got = {(r.doc_id, r.category): (r.accepted, r.score, r.reason) for r in classify(docs, tax, category_terms=spark.createDataFrame([("sport", "stadium")], "category string, gram string")).collect()}
    supported, bare = "ambiguous_keyword_supported_by_full_sentence", "ambiguous_keyword_without_category_context"
    assert got == {
        (1, "fire"): (True, 0.75, "explicit_category_keyword"),  # 0.72 + 0.03 for its priority
        (2, "sport"): (False, 0.0, bare),
        (3, "sport"): (True, 0.67, supported),  # 0.56 + 0.06 for the second term + 0.05
        (4, "sport"): (True, 0.62, supported),  # 0.56 + 0.06 for the context
        (5, "sport"): (False, 0.0, "excluded_context"),
        (8, "sport"): (True, 0.62, supported),
    }
    assert keyword_hits(docs, tax).where("doc_id = 3").count() == 2


def test_terms_of_any_length_marks_and_spans(spark):
    tax = spark.createDataFrame(TAXONOMY, TAXONOMY_COLUMNS)
    docs = spark.createDataFrame([(1, "The ruling of the   Supreme Court of Appeal stands"), (2, "U.S. army, u.s.a. and us"), (3, "match-day, match day"), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.term, r.start) for r in keyword_hits(docs, tax, offsets=True).collect())
    assert got == [(1, "ruling of the supreme court of appeal", 4), (2, "u.s.", 0), (3, "match", 0), (3, "match", 11), (3, "match day", 11)] or got == [(1, "ruling of the supreme court of appeal", 4), (2, "u.s.", 0), (2, "u.s.", 11), (3, "match", 0), (3, "match", 11), (3, "match day", 11)]


def test_translation_checks(spark):
    from tessera.operators import translation as X

    rows = [
        (1, "Seven people were not hurt in 3 fires", "تین آگ میں سات افراد زخمی نہیں ہوئے", "en", "ur"),
        (2, "Seven people were hurt in fires today", "Saat log aag mein zakhmi huay aaj", "en", "ur"),
        (3, "The minister did not resign", "وزیر نے استعفیٰ دے دیا ہے", "en", "ur"),
        (4, "Prices rose by 5 percent", "", "en", "ur"),
        (5, "سات افراد زخمی", "Seven people hurt </s>", "ur", "en"),
    ]
    df = spark.createDataFrame(rows, "id int, s string, t string, a string, b string")
    checked = df.select("id", X.translation_verdict(X.translation_checks(F.col("s"), F.col("t"), F.col("a"), F.col("b"))).alias("v"))
    got = {r.id: (r.v.accepted, set(r.v.issues)) for r in checked.collect()}
    assert got[1] == (True, set()) and got[3] == (False, {"negation_preserved"}) and got[5] == (False, {"not_control_tokens"})
    assert not got[2][0] and {"target_script_present", "target_script_dominant", "no_roman_urdu_output", "numbers_preserved"} <= got[2][1]
    assert not got[4][0] and "non_empty" in got[4][1]


def test_names_negations_and_contradictions(spark):
    assert _one(spark, T.proper_names(F.col("t")), t="Today Imran Khan met NATO in Réleou. The end. جسٹس منصور علی") == ["imran khan", "nato", "today imran khan", "منصور علی"] or _one(spark, T.proper_names(F.col("t")), t="Today Imran Khan met NATO in Réleou. The end. جسٹس منصور علی") == ["nato", "today imran khan", "منصور علی"]
    assert _one(spark, T.numbers(F.col("t")), t="5g at 12 and 3.5") == ["12", "3", "5"]
    assert _one(spark, T.contradicts(F.array(F.lit("won")), F.array(F.lit("lost")))) and not _one(spark, T.contradicts(F.array(F.lit("won")), F.array(F.lit("won"))))
    assert S.contradict({"won", "x"}, {"شکست"}) and not S.contradict({"won"}, {"x"})


def test_story_fold(spark):
    rows = [
        (1, 1, 0, "s1", "en", "c", "h1", ["fire", "in", "market"], [], [], False, [1.0, 0.0, 0.0]),
        (1, 2, 180, "s1", "en", "c", "h1", ["fire", "in", "market"], [], [], False, [1.0, 0.0, 0.0]),
        (1, 3, 190, "s2", "en", "c", "h3", ["market", "fire"], [], [], False, [0.95, 0.3, 0.0]),
        (1, 4, 200, "s1", "en", "d", "h4", ["six", "dead"], ["6"], [], False, [1.0, 0.0, 0.0]),
        (1, 5, 210, "s1", "en", "d", "h5", ["six", "dead"], ["5"], [], False, [1.0, 0.0, 0.0]),
        (2, 6, 0, "s1", "en", "c", "h1", ["fire", "in", "market"], [], [], False, [1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(a, b, b, *r) for a, b, *r in rows], "day long, id long, seq long, minutes int, source string, lang string, category string, exact_hash string, tokens array<string>, numbers array<string>, names array<string>, negated boolean, vector array<double>")
    got = {r.id: (r.action, r.story_id) for r in S.cluster_stories(df).collect()}
    assert got == {1: ("created", 1), 2: ("merged", 1), 3: ("merged", 1), 4: ("created", 4), 5: ("pending_review", None), 6: ("created", 6)}


def test_ledger_is_additive(spark):
    rows = [(1, 1, "a", ["x", "y"], [], [], False, [1.0, 0.0]), (1, 2, "a", ["x", "y"], [], [], False, [1.0, 0.0]), (1, 3, "b", ["x", "y"], [], [], False, [0.99, 0.05]), (1, 4, "c", ["q"], ["7"], [], False, [0.9, 0.4]), (1, 5, "d", ["z"], [], [], False, [0.0, 1.0]), (1, 6, "e", ["x", "y"], [], [], True, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "day long, id long, hash string, tokens array<string>, numbers array<string>, names array<string>, negated boolean, vector array<double>")
    got = {r.id: (r.decision, r.fact_order) for r in S.fold_facts(df).collect()}
    assert got == {1: ("append", 1), 2: ("duplicate", None), 3: ("duplicate", None), 4: ("review", None), 5: ("append", 2), 6: ("review", None)}


def test_reconstruct_and_frames(spark):
    rows = spark.createDataFrame([(1, 0, "the rain in"), (1, 1, "rain in Spain fell."), (1, 2, "It stopped")], "conv_id long, turn long, text string")
    assert [r.sentence for r in S.reconstruct(rows).orderBy("pos").collect()] == ["the rain in Spain fell.", "It stopped"]
    lines = spark.createDataFrame([(1, "primary", "HELLO", 0.8, "en", 0.0, 0.0, 10.0, 10.0), (1, "fallback", "HELLO", 0.9, "en", 0.0, 0.0, 10.0, 10.0), (1, "fallback", "far", 0.9, "en", 50.0, 50.0, 60.0, 60.0)], "frame long, engine string, text string, confidence double, script string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.text, r.confidence) for r in S.merge_frame_lines(lines).orderBy("pos").collect()] == [("HELLO", 0.9), ("far", 0.9)]


def test_manifests(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text('# note\n\n{"id": "1", "text": "t", "expected_terms": ["x"]}\n')
    r = M.keyword_cases(spark, str(tmp_path / "k.jsonl")).first()
    assert (r.language, r.expected_terms, r.expected_categories) == ("mixed", ["x"], [])
    case = {"id": "1", "frames": [{"sequence": 1, "lines": [{"text": "a", "script": "en", "polygon": [[0, 1], [4, 3]]}]}]}
    (tmp_path / "s.jsonl").write_text(json.dumps(case) + "\n")
    r = M.frame_lines(M.json_lines(spark, str(tmp_path / "s.jsonl"), M.SEGMENT_CASES)).first()
    assert (r.x0, r.y0, r.x1, r.y1, r.accepted) == (0.0, 1.0, 4.0, 3.0, True)
    good, bad = M.checked_commands(spark.createDataFrame([("1", "k", "b", "no", 0)], M.COMMANDS))
    assert (good.count(), bad.count()) == (0, 1)
