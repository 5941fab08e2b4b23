"""Text, pair and keyword queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators.keywords import IN_PLAN, classify, keyword_hits
from tessera.operators.similar_lines import similar_pairs
from tessera.session import stored, table

#: The taxonomy of these queries: category, term, whether it needs context, context terms, excluded terms, priority.
TAXONOMY = (
    ("motion", "the and", False, "", "", "normal"),
    ("motion", "thtion", True, "the,of", "erea", "high"),
    ("license", "rights reserved", False, "all rights", "", "critical"),
    ("license", "license", True, "licensed,version", "", "normal"),
    ("german", "und", True, "der,die,das", "", "normal"),
    ("german", "nicht aulich", False, "", "nicht", "high"),
    ("french", "le ouè", False, "", "", "normal"),
    ("french", "de", True, "le,la", "und", "normal"),
)
#: Terms that are context for any ambiguous term of their category.
CATEGORY_TERMS = (("license", "software"), ("german", "für sch"), ("french", "avec"))


#: What trims a line: Unicode's space separators. Ids of sentences that are sent to every executor; more are joined by a shuffle.
SPACES, IDS_SENT = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", 2_000_000


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(c, t, r, x.split(",") if x else [], e.split(",") if e else [], p) for c, t, r, x, e, p in TAXONOMY]
    return spark.createDataFrame(rows, "category string, term string, requires_context boolean, context_terms array<string>, excluded_terms array<string>, priority string")


def category_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_TERMS, "category string, gram string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_search_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.array(F.lit("the"), F.lit("of"), F.lit("licensed"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return _docs(spark, sf_dir).where(F.forall(query, lambda t: F.array_contains(words, t))).select("doc_id")


def text_search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.instr(F.lower("text"), "100%") + F.instr(F.lower("text"), "rights res") > 0).select("doc_id", "lang")


def exact_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(T.exact_hash(F.col("text")).alias("exact_hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("occurrences"))


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.match_normalised(F.col("text"))).alias("normalised_md5"))


def number_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.numbers(F.col("text")), ",").alias("numbers"))


def proper_name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.proper_names(F.col("text")), "|").alias("names"))


def script_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(T.script_profile(F.col("text")).alias("script"), T.valid_unit(F.col("text")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines as sentences: (doc_id, pos, lang, text)."""
    return docs.select("doc_id", "lang", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))


def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct sentences of one language with token overlap of 0.5 or more, through shared tokens that are rare
    enough to mark a pair: the prefix of each sentence's tokens by rarity that any partner must share. Until a pair is
    found, hashes stand for the sentence and its tokens; the tokens themselves then tell the overlap."""
    lower = lambda c: F.lower(F.when(F.contains(c, F.lit("İ")) | F.contains(c, F.lit("Σ")), F.translate(c, "İΣ", "iσ")).otherwise(c))
    lines = _lines(_docs(spark, sf_dir)).where("lang is not null").select("lang", lower(F.btrim("line", F.lit(SPACES))).alias("s")).withColumn("k", F.xxhash64("lang", "s"))
    tokens = F.array_distinct(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    hashed = lines.select("k", F.transform(tokens, lambda x: F.xxhash64("lang", x)).alias("hs")).where(F.size("hs") >= 4)
    words = lines.select("lang", F.explode(F.split("s", " ")).alias("w")).select(F.xxhash64("lang", "w").alias("h"))
    pairs = stored(similar_pairs(hashed, words))
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct())
    ids = F.broadcast(ids) if ids.count() <= IDS_SENT else ids
    sets = stored(lines.join(ids, "k", "left_semi").select("k", "lang", "s").distinct()).withColumn("t", tokens)
    both = pairs.join(sets.toDF("a", "lang", "sa", "ta"), "a").join(sets.toDF("b", "lang_b", "sb", "tb"), "b").where("lang = lang_b")
    return both.withColumn("jaccard", F.round(T.token_jaccard(F.col("ta"), F.col("tb")), 6)).where("jaccard >= 0.5").select("lang", F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"), "jaccard")


def cosine_pairs_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs within a label's block; the block is the operator's bound, as categories are in the story table."""
    pairs = V.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.2995)
    return pairs.select("a", "b", "label", (F.round("sim", 3) + 0.0).alias("sim")).where("sim >= 0.3")


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_pairs_blocked(spark, sf_dir).groupBy("a").agg(F.max_by("b", F.struct("sim", -F.col("b"))).alias("candidate"), F.max("sim").alias("sim"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", F.posexplode_outer("embedding").alias("dim", "x")).groupBy("label", "dim").agg((F.round(F.avg(F.col("x").cast("double")), 6) + 0.0).alias("mean"))


def keyword_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_hits(_docs(spark, sf_dir), taxonomy(spark)).groupBy("doc_id", "category", "term").agg(F.count(F.lit(1)).alias("hits"))


def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(_docs(spark, sf_dir), taxonomy(spark), category_terms=category_terms(spark))
    return out.select("doc_id", "category", "accepted", "score", "reason", F.array_join("terms", "|").alias("terms"), F.size("context").cast("long").alias("n_context"), F.size("excluded").cast("long").alias("n_excluded"))


def keyword_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit's span of characters in the normalised text."""
    hits = keyword_hits(_docs(spark, sf_dir), taxonomy(spark), offsets=True)
    return hits.select("doc_id", "category", "term", F.col("start").cast("long").alias("span_start"), (F.col("start") + F.length("term")).cast("long").alias("span_end"))


def keyword_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (not hits) by source, category and term."""
    hits = keyword_hits(_docs(spark, sf_dir), taxonomy(spark)).select("doc_id", "category", "term").distinct()
    return hits.join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source", "category", "term").agg(F.count(F.lit(1)).alias("stories"))


def classification_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a rule for junk (many symbols) against the labels."""
    junk = F.regexp_count("text", F.lit(r"[#$%&|*]")) * 20 > F.length("text")
    scored = _docs(spark, sf_dir).select("doc_id", junk.alias("said")).join(table(spark, sf_dir, "labels"), "doc_id").select("said", (F.col("quality") == 0).alias("true"))
    sums = scored.agg(F.count_if(F.col("said") & F.col("true")).alias("tp"), F.count_if(F.col("said") & ~F.col("true")).alias("fp"), F.count_if(~F.col("said") & F.col("true")).alias("fn"))
    return sums.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in their text: candidates by three words inside the item, then containment.

    An item may begin and end inside a word of the text, so its first and last words mark nothing; those between stand in
    the text as they are. Of their runs of three (fewer, where the item has no more) the longest is the item's key; texts
    are looked at only where a key's first word stands. Items without a word inside are compared with every text.
    A digest stands for the text until candidates are found, so equal texts are looked at once and rows are kept apart.
    """
    split = lambda c: F.split(F.translate(c, "\n", " "), " ")
    run = lambda w, i, n: F.array_join(F.slice(w, i, n), " ")
    w, inside = F.col("w"), F.size("w") - 2
    items = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.col("text").alias("item"), split("text").alias("w")).withColumn("n", F.least(inside, F.lit(3)))
    runs = F.transform(F.sequence(F.lit(2), F.size(w) - F.col("n")), lambda i: F.struct(F.length(run(w, i, F.col("n"))).alias("size"), run(w, i, F.col("n")).alias("key"), F.get(w, i - 1).alias("first")))
    keyed = items.where("n > 0").withColumn("best", F.array_max(runs)).select("item_id", "item", "n", "best.key", "best.first")
    sizes = [r[0] for r in keyed.select("n").distinct().collect()]
    firsts = [r[0] for r in keyed.select("first").distinct().limit(IN_PLAN + 1).collect()]
    wanted = lambda x: x.isin(*firsts) if 0 < len(firsts) <= IN_PLAN else F.lit(True)
    docs = _docs(spark, sf_dir).where("text is not null").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    places = F.filter(F.transform(split("text"), lambda x, i: F.when(wanted(x), i + 1)), lambda i: i.isNotNull())
    words = docs.select("digest", split("text").alias("w"), places.alias("at")).where(F.size("at") > 0)
    keyed_by = lambda n: F.transform("at", lambda i: F.struct(F.lit(n).alias("n"), run(w, i, n).alias("key")))
    short = items.where("n <= 0").select("item_id", "item")
    whole = docs.join(F.broadcast(short), F.contains("text", F.col("item"))).select("doc_id", "item_id")
    if not sizes:
        return whole
    met = words.select("digest", F.explode(F.array_distinct(F.flatten(F.array(*map(keyed_by, sizes))))).alias("k")).select("digest", "k.*").join(keyed, ["n", "key"]).select("digest", "item_id", "item").distinct()
    return met.join(docs, "digest").where(F.contains("text", F.col("item"))).select("doc_id", "item_id").unionAll(whole)


def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode_outer(T.sentences("text")).alias("pos", "sentence"))


def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's name against the next one's (ASCII, so bytes are characters)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    nxt = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("next_name"))
    return c.join(nxt, "c_custkey").select("c_custkey", F.round(T.edit_similarity(F.col("c_name"), F.col("next_name")), 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (text_search_all_tokens, text_search_substring, exact_hash_groups, normalised_text, number_signatures, proper_name_sets, script_profiles, token_jaccard_pairs, cosine_pairs_blocked, best_candidate, label_centroids, keyword_hit_counts, keyword_classify, keyword_spans, keyword_frequency, classification_quality, benchmark_containment, html_titles, sentence_split, edit_similarity)}

_NORM = r"trim(regexp_replace(lower(text), '[ \t\r\n\f]+', ' ', 'g'))"
_KEY = rf"trim(regexp_replace({_NORM}, '[\p{{P}}\p{{S}} ]+', ' ', 'g'))"
_PAIRS = "select a.vec_id as a, b.vec_id as b, a.label, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 3) + 0.0 as sim from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 3) >= 0.3"
_LIST = lambda x: f"[{', '.join(repr(y) for y in x.split(',') if y)}]::varchar[]"
_TAXONOMY = "(values " + ", ".join(f"('{c}', '{t}', {str(r).lower()}, {_LIST(x)}, {_LIST(e)}, '{p}')" for c, t, r, x, e, p in TAXONOMY) + ") as k(category, term, requires_context, context_terms, excluded_terms, priority)"
_SHARED = "(values " + ", ".join(f"('{c}', '{g}')" for c, g in CATEGORY_TERMS) + ") as s(category, gram)"
# Words and what stands between them: a term of one word is one piece, of two words three.
_WORDS = rf"select doc_id, source, regexp_extract_all({_NORM}, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_]+') as w from documents"
_GRAMS = f"select doc_id, source, i, n, array_to_string(w[i:i+n-1], '') as gram from (select *, unnest(range(1, len(w) + 1)) as i from ({_WORDS})) , (values (1), (3)) as s(n) where i + n - 1 <= len(w)"
_PLACED = _GRAMS.replace(" as gram from", " as gram, w from")
_LATIN = r"regexp_replace(text, '[\p{L}\p{N}_]*[^\x00-\x7F][\p{L}\p{N}_]*', '#', 'g')"  # words with other letters are no names
_NAMES = rf"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({_LATIN}, '\b(?:[A-Z][a-z]+|[A-Z]{{2,}})(?:\s+(?:[A-Z][a-z]+|[A-Z]{{2,}})){{0,3}}\b'), lambda x: x not in {T.NO_NAMES!r}), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g')))))"
_NUMBERS = rf"list_sort(list_distinct(list_filter(regexp_extract_all({_KEY}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[0-9]+'))))"
ORACLES = {
    "text_search_all_tokens": r"select doc_id from documents where list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['the', 'of', 'licensed'])",
    "text_search_substring": "select doc_id, lang from documents where lower(text) like '%100\\%%' escape '\\' or lower(text) like '%rights res%'",
    "exact_hash_groups": f"select sha256({_KEY}) as exact_hash, min(doc_id) as first_doc, count(*) as occurrences from documents group by 1",
    "normalised_text": f"select doc_id, md5({_NORM}) as normalised_md5 from documents",
    "number_signatures": f"select doc_id, array_to_string({_NUMBERS}, ',') as numbers from documents",
    "proper_name_sets": f"select doc_id, array_to_string({_NAMES}, '|') as names from documents",
    "script_profiles": r"select case when regexp_matches(text, '[A-Za-z]') then 'en' else 'unknown' end as script, len(regexp_extract_all(text, '[\p{L}\p{N}]')) >= 8 and len(regexp_extract_all(text, '[^ \n]+')) >= 3 as valid, count(*) as n from documents group by 1, 2",
    "token_jaccard_pairs": r"with s as (select distinct lang, lower(trim(line)) as s from (select lang, unnest(string_split(text, chr(10))) as line from documents)), t as (select lang, s, list_distinct(regexp_extract_all(s, '[\p{L}\p{N}_]+')) as t from s), u as (select *, row_number() over () as k, len(t) as n from t where len(t) >= 4), w as (select lang, k, n, unnest(t) as w from u), c as (select a.k as ka, b.k as kb, a.n + b.n as total, count(*) as common from w a join w b on a.lang = b.lang and a.w = b.w and a.k < b.k and 2 * least(a.n, b.n) >= greatest(a.n, b.n) group by 1, 2, 3) select a.lang, least(a.s, b.s) as a, greatest(a.s, b.s) as b, round(common / (total - common), 6) as jaccard from c join u a on a.k = ka join u b on b.k = kb where round(common / (total - common), 6) >= 0.5",
    "cosine_pairs_blocked": _PAIRS,
    "best_candidate": f"select a, arg_max(b, (sim, -b)) as candidate, max(sim) as sim from ({_PAIRS}) group by 1",
    "label_centroids": "select label, i - 1 as dim, round(avg(embedding[i]::double), 6) + 0.0 as mean from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2",
    "keyword_hit_counts": f"select doc_id, category, term, count(*) as hits from ({_GRAMS}) join {_TAXONOMY} on gram = term group by 1, 2, 3",
    "keyword_frequency": f"select source, category, term, count(distinct doc_id) as stories from ({_GRAMS}) join {_TAXONOMY} on gram = term group by 1, 2, 3",
    "classification_quality": r"with s as (select len(regexp_extract_all(text, '[#$%&|*]')) * 20 > length(text) as said, quality = 0 as true_ from documents join labels using (doc_id)), c as (select count(*) filter (said and true_) as tp, count(*) filter (said and not true_) as fp, count(*) filter (not said and true_) as fn from s) select tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from c",
    "benchmark_containment": "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)",
    "html_titles": "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages",
    "edit_similarity": "select a.c_custkey, round(1 - levenshtein(a.c_name, b.c_name) / greatest(length(a.c_name), length(b.c_name), 1), 6) as similarity from customer a join customer b on b.c_custkey = a.c_custkey + 1",
}
ORACLES["keyword_spans"] = f"select doc_id, category, term, len(array_to_string(w[1:i-1], ''))::bigint as span_start, (len(array_to_string(w[1:i-1], '')) + len(term))::bigint as span_end from ({_PLACED}) join {_TAXONOMY} on gram = term"
ORACLES["keyword_classify"] = f"""with wanted as (select distinct unnest([term] || context_terms || excluded_terms) as gram from {_TAXONOMY} union select gram from {_SHARED}),
grams as (select distinct doc_id, gram from ({_GRAMS}) join wanted using (gram)),
hits as (select doc_id, category, term, requires_context, context_terms, excluded_terms, priority from grams join {_TAXONOMY} on gram = term),
own as (select distinct doc_id, category, term from hits),
ctx as (select doc_id, category, gram from (select doc_id, category, term, unnest(context_terms) as gram from hits) x join grams using (doc_id, gram) where gram <> term
  union select h.doc_id, h.category, gram from (select distinct doc_id, category from hits) h join {_SHARED} on s.category = h.category join grams using (doc_id, gram) where not exists (select 1 from own where own.doc_id = h.doc_id and own.category = h.category and own.term = gram)),
exc as (select distinct doc_id, category, gram from (select doc_id, category, unnest(excluded_terms) as gram from hits) x join grams using (doc_id, gram)),
agg as (select doc_id, category, count(distinct term) as n, count(distinct term) filter (not requires_context) as strong, max(case priority when 'critical' then 2 when 'high' then 1 else 0 end) as rank, array_to_string(list_sort(list_distinct(list(term))), '|') as terms from hits group by 1, 2),
f as (select *, case rank when 1 then 0.03 when 2 then 0.05 else 0.0 end as bonus from agg left join (select doc_id, category, count(*) as n_context from ctx group by 1, 2) using (doc_id, category) left join (select doc_id, category, count(*) as n_excluded from exc group by 1, 2) using (doc_id, category)),
g as (select doc_id, category, terms, n, strong, bonus, coalesce(n_context, 0)::bigint as n_context, coalesce(n_excluded, 0)::bigint as n_excluded from f),
r as (select *, case when n_excluded > 0 and strong = 0 then 'excluded_context' when strong > 0 then 'explicit_category_keyword' when n_context > 0 or n >= 2 then 'ambiguous_keyword_supported_by_full_sentence' else 'ambiguous_keyword_without_category_context' end as reason from g)
select doc_id, category, reason in ('explicit_category_keyword', 'ambiguous_keyword_supported_by_full_sentence') as accepted,
  round(least(1.0, greatest(0.0, case reason when 'explicit_category_keyword' then 0.72 + least(0.14, 0.05 * (strong - 1)) + least(0.08, 0.03 * n_context) + bonus - least(0.25, 0.12 * n_excluded)
    when 'ambiguous_keyword_supported_by_full_sentence' then 0.56 + least(0.18, 0.06 * n_context) + least(0.12, 0.06 * (n - 1)) + bonus else 0.0 end)), 6)::double as score, reason, terms, n_context, n_excluded from r"""
