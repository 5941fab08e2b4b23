"""Exact keyword matching and context-aware, multi-label classification.

A taxonomy is a table of category, term, requires_context, context_terms, excluded_terms and priority (normal, high or
critical). Texts and terms are cut into words and what stands between them; a term matches where its pieces stand in a
row and words are whole. Only places of a term's first word are looked at further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import match_normalised

#: Rows of a taxonomy up to which it is broadcast, and first words up to which places are told by a set in the plan.
BROADCAST_ROWS, IN_PLAN = 100_000, 5_000
_PIECES = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+"
_NOT_A_WORD = r"[^\p{L}\p{N}\p{M}_]$"


def pieces(text: Column) -> Column:
    """Words, and what stands between them, of a normalised text, in order."""
    return F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))


def _patterns(terms: DataFrame) -> DataFrame:
    """`terms` (gram, ...) with their first piece, which must be a word for any place to match, and their number of pieces."""
    norm = terms.withColumn("gram", match_normalised(F.col("gram"))).where("gram <> ''")
    return norm.withColumn("__p", pieces(F.col("gram"))).withColumns({"first": F.get("__p", F.lit(0)), "size": F.size("__p")}).drop("__p")


def gram_places(docs: DataFrame, terms: DataFrame, text: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, start, ...columns of `terms`): each place of each of the `terms` (gram, ...), nested ones too.

    start counts words and what stands between them; with `offsets` it is the character in the normalised text.
    """
    patterns = _patterns(terms)
    total = patterns.agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.countDistinct("first").alias("firsts")).first()
    longest, small = total["size"] or 1, total["n"] <= BROADCAST_ROWS
    cut = docs.select("doc_id", pieces(match_normalised(F.col(text))).alias("w"))
    if total["firsts"] <= IN_PLAN:
        firsts = [r["first"] for r in patterns.select("first").distinct().collect()]  # IN_PLAN words at most
        wanted = lambda x: x.isin(*firsts) if firsts else F.lit(False)
    else:
        wanted = lambda x: F.lit(True)
    at = F.filter(F.transform("w", lambda x, i: F.when(wanted(x), i)), lambda i: i.isNotNull())
    before = (lambda i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))) if offsets else (lambda i: i)
    places = cut.select("doc_id", "w", at.alias("at")).where(F.size("at") > 0)
    places = places.select("doc_id", F.explode(F.transform("at", lambda i: F.struct(before(i).alias("start"), F.get("w", i).alias("first"), F.slice("w", i + 1, longest).alias("next")))).alias("place")).select("doc_id", "place.*")
    met = places.join(F.broadcast(patterns) if small else patterns, "first")
    said = F.array_join(F.slice("next", F.lit(1), F.col("size")), "")
    whole = F.startswith(said, F.col("gram")) & ((F.length(said) == F.length("gram")) | F.regexp_like("gram", F.lit(_NOT_A_WORD)))
    return met.where(whole).drop("first", "next", "size")


def keyword_hits(docs: DataFrame, taxonomy: DataFrame, text: str = "text", offsets: bool = False) -> DataFrame:
    """Each place of each term, nested and overlapping ones too; words are matched whole."""
    return gram_places(docs, taxonomy.withColumnRenamed("term", "gram"), text, offsets).withColumnRenamed("gram", "term")


def classify(docs: DataFrame, taxonomy: DataFrame, text: str = "text", category_terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, category, accepted, score, reason, terms, context, excluded) of every category with a hit.

    A strong term (that requires no context) accepts. An ambiguous one needs context (a context term of a matched term
    or one of `category_terms` (category, gram), which is not itself matched) or a second matched term. Excluded terms
    of matched terms reject where no term is strong, and lower the score where one is. Scores are the method's fixed
    steps, within 0 and 1. One pass over the texts finds all kinds of terms.
    """
    own = taxonomy.select(F.col("term").alias("gram"), F.lit("term").alias("part"), "category", F.col("term").alias("owner"), "requires_context", "priority")
    side = lambda part, column: taxonomy.select(F.explode(column).alias("gram"), F.lit(part).alias("part"), "category", F.col("term").alias("owner"), F.lit(None).cast("boolean").alias("requires_context"), F.lit(None).cast("string").alias("priority"))
    terms = own.union(side("context", "context_terms")).union(side("excluded", "excluded_terms"))
    if category_terms is not None:
        terms = terms.union(category_terms.select("gram", F.lit("shared"), "category", F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("string")))
    found = gram_places(docs, terms, text)
    only = lambda part, x: F.collect_set(F.when(F.col("part") == part, x))
    rank = F.when(F.col("priority") == "critical", 2).when(F.col("priority") == "high", 1).otherwise(0)
    pair = F.struct("owner", "gram")
    by = found.groupBy("doc_id", "category").agg(only("term", F.col("owner")).alias("terms"), F.collect_set(F.when((F.col("part") == "term") & ~F.col("requires_context"), F.col("owner"))).alias("strong"), only("context", pair).alias("context"), only("shared", F.col("gram")).alias("shared"), only("excluded", pair).alias("excluded"), F.max(F.when(F.col("part") == "term", rank)).alias("rank"))
    by = by.where(F.size("terms") > 0)
    of_matched = lambda pairs: F.transform(F.filter(pairs, lambda p: F.array_contains(F.col("terms"), p["owner"]) & (p["gram"] != p["owner"])), lambda p: p["gram"])
    by = by.withColumns({"context": F.array_sort(F.array_union(F.array_except("shared", "terms"), of_matched("context"))), "excluded": F.array_sort(F.array_distinct(of_matched("excluded")))})
    n_terms, n_strong, n_context, n_excluded = (F.size(c) for c in ("terms", "strong", "context", "excluded"))
    reason = F.when((n_excluded > 0) & (n_strong == 0), "excluded_context").when(n_strong > 0, "explicit_category_keyword").when((n_context > 0) | (n_terms >= 2), "ambiguous_keyword_supported_by_full_sentence").otherwise("ambiguous_keyword_without_category_context")
    weight = F.when(F.col("rank") == 1, 0.03).when(F.col("rank") == 2, 0.05).otherwise(0.0)
    strong = 0.72 + F.least(F.lit(0.14), 0.05 * (n_strong - 1)) + F.least(F.lit(0.08), 0.03 * n_context) + weight - F.least(F.lit(0.25), 0.12 * n_excluded)
    weak = 0.56 + F.least(F.lit(0.18), 0.06 * n_context) + F.least(F.lit(0.12), 0.06 * (n_terms - 1)) + weight
    by = by.withColumn("reason", reason).withColumn("accepted", F.col("reason").isin("explicit_category_keyword", "ambiguous_keyword_supported_by_full_sentence"))
    score = F.when(~F.col("accepted"), 0.0).when(n_strong > 0, strong).otherwise(weak)
    return by.select("doc_id", "category", "accepted", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("score"), "reason", F.array_sort("terms").alias("terms"), "context", "excluded")
