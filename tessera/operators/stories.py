"""Order-dependent operators: story clustering, the additive fact ledger, reconstruction, frame merging.

Each is a fold over one key's rows in order. The fold runs per key in applyInPandas; keys (calendar days, conversations,
frames) are as many as the data is long, and one key's rows are what the fold must see together by its definition.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import cosine

# The thresholds of the decisions.
SAME_DAY, CROSS_CHANNEL, CROSS_LANGUAGE, REVIEW, OVERLAP, STRONG = 0.93, 0.90, 0.94, 0.84, 0.24, 0.965
FACT_DUPLICATE, FACT_OVERLAP, FACT_REVIEW = 0.94, 0.20, 0.86
WINDOW_MINUTES = 30


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    c = F.col(text)
    out = docs.withColumns({"exact_hash": T.exact_hash(c), "tokens": T.tokens(c), "numbers": T.numbers(c), "names": T.proper_names(c)})
    return out.withColumn("negated", F.size(T.negations(F.col("tokens"))) > 0)


def same_language(a: Column, b: Column) -> Column:
    return (a == b) | (a == "mixed") | (b == "mixed")


def pair_decision(pairs: DataFrame) -> DataFrame:
    """`pairs` with sim, overlap, guarded and decision (merge, review or create) of columns suffixed _a and _b.

    Needs vector, tokens, numbers, names, negated, lang, source and minutes on both sides, of one category.
    """
    both = lambda name: (F.col(f"{name}_a"), F.col(f"{name}_b"))
    guards = T.names_compatible(*both("names")) & (F.col("numbers_a") == F.col("numbers_b")) & (F.col("negated_a") == F.col("negated_b")) & ~T.contradicts(*both("tokens"))
    window = (F.col("source_a") != F.col("source_b")) & (F.abs(F.col("minutes_a") - F.col("minutes_b")) <= WINDOW_MINUTES)
    threshold = F.when(~same_language(*both("lang")), CROSS_LANGUAGE).when(window, CROSS_CHANNEL).otherwise(SAME_DAY)
    out = pairs.withColumns({"sim": cosine(*both("vector")), "overlap": T.token_jaccard(*both("tokens")), "guarded": guards})
    merged = (F.col("sim") >= threshold) & ((F.col("overlap") >= OVERLAP) | (F.col("sim") >= STRONG)) & F.col("guarded")
    return out.withColumn("decision", F.when(merged, "merge").when(F.col("sim") >= REVIEW, "review").otherwise("create"))


def contradict(a: set[str], b: set[str]) -> bool:
    """As T.contradicts, of token sets."""
    return any(x and y and x != y for x, y in ((a & set(g), b & set(g)) for g in T.CONTRADICTIONS))


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


class StoryBook:
    """The stories of one key so far, and which of them has a row of each exact hash."""

    def __init__(self, state: dict | None = None) -> None:
        state = state or {"stories": [], "hashes": {}}
        self.stories = [s | {"vector": np.asarray(s["vector"], np.float32)} | {k: set(s[k]) for k in ("sources", "categories", "tokens")} for s in state["stories"]]
        self.by_hash = {h: self.stories[k] for h, k in state["hashes"].items()}

    def dump(self) -> dict:
        """Plain data, fit for JSON."""
        place = {id(s): k for k, s in enumerate(self.stories)}
        stories = [s | {"vector": s["vector"].tolist()} | {k: sorted(s[k], key=str) for k in ("sources", "categories", "tokens")} for s in self.stories]
        return {"stories": stories, "hashes": {h: place[id(s)] for h, s in self.by_hash.items()}}

    def take(self, r) -> tuple[int | None, str]:
        """(story_id, action) of the next row."""
        vector, tokens = _unit(np.asarray(r.vector, np.float32)), set(r.tokens)
        categories = {r.category} if r.category is None or isinstance(r.category, str) else set(r.category)
        story = self.by_hash.get(r.exact_hash)
        action = "merged" if story else "created"
        if story is None:
            best, top = None, -1.0
            for s in reversed(self.stories):
                if categories & s["categories"] and (sim := round(float(s["vector"] @ vector), 6)) > top:
                    best, top = s, sim
            if best is not None:
                window = r.source not in best["sources"] and abs(r.minutes - best["minutes"]) <= WINDOW_MINUTES
                alike = r.lang == best["lang"] or "mixed" in (r.lang, best["lang"])
                need = CROSS_LANGUAGE if not alike else CROSS_CHANNEL if window else SAME_DAY
                union = tokens | best["tokens"]
                lexical = len(tokens & best["tokens"]) / len(union) if union else 1.0
                guarded = list(r.numbers) == best["numbers"] and list(r.names) == best["names"] and bool(r.negated) == best["negated"] and not contradict(tokens, best["tokens"])
                if top >= need and (lexical >= OVERLAP or top >= STRONG) and guarded:
                    story, action = best, "merged"
                elif top >= REVIEW:
                    return None, "pending_review"
        if story is None:
            story = {"id": int(r.id), "vector": vector, "n": 0, "sources": set(), "categories": set(), "minutes": int(r.minutes)}
            self.stories.append(story)
        story["vector"] = _unit((story["vector"] * story["n"] + vector) / (story["n"] + 1)).astype(np.float32)
        story["n"] += 1
        story["sources"].add(r.source)
        story["categories"] |= categories
        story |= {"minutes": max(story["minutes"], int(r.minutes)), "lang": r.lang, "tokens": tokens, "numbers": list(r.numbers), "names": list(r.names), "negated": bool(r.negated)}
        self.by_hash[r.exact_hash] = story
        return story["id"], action


def cluster_stories(rows: DataFrame, key: str = "day") -> DataFrame:
    """(key, id, story_id, action): created, merged or pending_review, row by row in order of (seq, id).

    An exact repeat merges; else only the most similar story counts: it takes the row, or holds it for review, or the
    row founds a story. A story's vector is the running mean of its rows, made unit length at each step. A row held for
    review founds nothing. Columns: key, id, seq, minutes, source, lang, category, exact_hash, tokens, numbers, names,
    negated, vector. `category` is one or an array.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        book = StoryBook()
        out = [(getattr(r, key), r.id, *book.take(r)) for r in frame.sort_values(["seq", "id"]).itertuples()]
        return pd.DataFrame(out, columns=[key, "id", "story_id", "action"]).astype({"story_id": "Int64"})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandas(fold, f"{key} {kind}, id long, story_id long, action string")


def cluster_stories_stream(rows: DataFrame, key: str = "day") -> DataFrame:
    """cluster_stories of a stream: each key's stories stay in the state store, a micro-batch's rows are put in order.

    A row that comes after later ones is compared with the stories as they are then; none is dropped for being late.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(day, batches, state):
        book = StoryBook(json.loads(state.get[0])) if state.exists else StoryBook()
        frame = pd.concat(list(batches)).sort_values(["seq", "id"])
        out = [(day[0], r.id, *book.take(r)) for r in frame.itertuples()]
        state.update((json.dumps(book.dump()),))
        yield pd.DataFrame(out, columns=[key, "id", "story_id", "action"]).astype({"story_id": "Int64"})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, id long, story_id long, action string", "body string", "append", GroupStateTimeout.NoTimeout)


def fold_facts(rows: DataFrame, key: str = "day") -> DataFrame:
    """(key, id, decision, fact_order): duplicate, review or append of each candidate fact, in order of id.

    The ledger is additive: an appended fact never changes. Columns: key, id, hash, tokens, numbers, names, negated, vector.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        facts, hashes, out = [], set(), []
        for r in frame.sort_values("id").itertuples():
            vector, tokens, decision = _unit(np.asarray(r.vector, np.float32)), set(r.tokens), "append"
            if r.hash in hashes:
                decision = "duplicate"
            elif facts:
                scored = [(round(float(f[0] @ vector), 6), len(tokens & f[1]) / max(1, len(tokens | f[1]))) for f in facts]
                k = max(range(len(facts)), key=lambda j: (scored[j], -j))
                (sim, lexical), same = scored[k], (list(r.numbers), list(r.names), bool(r.negated)) == facts[k][2:] and not contradict(tokens, facts[k][1])
                decision = "duplicate" if sim >= FACT_DUPLICATE and lexical >= FACT_OVERLAP and same else "review" if sim >= FACT_REVIEW else "append"
            if decision == "append":
                facts.append((vector, tokens, list(r.numbers), list(r.names), bool(r.negated)))
                hashes.add(r.hash)
            out.append((getattr(r, key), r.id, decision, len(facts) if decision == "append" else None))
        return pd.DataFrame(out, columns=[key, "id", "decision", "fact_order"]).astype({"fact_order": "Int64"})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandas(fold, f"{key} {kind}, id long, decision string, fact_order long")


def reconstruct(rows: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(key, pos, sentence): fragments of a track merged by exact token overlap, finished sentences emitted once."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        pending: list[str] = []
        out, seen = [], set()

        def emit(sentence: str) -> None:
            if sentence.casefold() not in seen:
                seen.add(sentence.casefold())
                out.append((frame[key].iloc[0], len(out), sentence))

        for fragment in frame.sort_values([order, text])[text].fillna(""):
            merged, how = T.merge_overlap(pending, fragment.split())
            if how == "no_overlap" and pending:
                emit(" ".join(pending))
                merged = fragment.split()
            done, rest = T.split_sentences(" ".join(merged if pending else fragment.split()))
            for s in done:
                emit(s)
            pending = rest.split()
        if pending:  # the end of the stream flushes what is left
            emit(" ".join(pending))
        return pd.DataFrame(out, columns=[key, "pos", "sentence"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, order, text).groupBy(key).applyInPandas(fold, f"{key} {kind}, pos long, sentence string")


def merge_frame_lines(lines: DataFrame) -> DataFrame:
    """OCR lines of two engines merged by frame: boxes that overlap little are added, of alike texts the surer reading
    stays with the other as its alternative, different scripts are joined, else the surer line stays.

    Columns: frame, engine, text, confidence, script, x0, y0, x1, y1. Likeness is 1 - edit distance / longer length.
    """

    def over(a, b) -> float:
        w, h = max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0)), max(0.0, min(a.y1, b.y1) - max(a.y0, b.y0))
        union = (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h
        return w * h / union if union > 0 else 0.0

    def likeness(a: str, b: str) -> float:
        a, b = " ".join(a.casefold().split()), " ".join(b.casefold().split())
        if a == b:
            return 1.0
        y, at = np.frombuffer(b.encode("utf-32-le"), np.uint32), np.arange(len(b) + 1)
        row = at
        for k, c in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32)):
            step = np.minimum(row[1:] + 1, row[:-1] + (y != c))
            row = np.minimum.accumulate(np.concatenate([[k + 1], step]) - at) + at
        return 1 - float(row[-1]) / max(len(a), len(b))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["engine", "y0", "x0", "text"]).assign(alternatives="")
        merged = [r for r in rows.itertuples(index=False) if r.engine == "primary"]
        for r in (r for r in rows.itertuples(index=False) if r.engine != "primary"):
            k = max(range(len(merged)), key=lambda j: over(merged[j], r), default=None)
            if k is None or over(merged[k], r) < 0.35:
                merged.append(r)
            elif likeness(merged[k].text, r.text) >= 0.85:
                winner, loser = (r, merged[k]) if r.confidence > merged[k].confidence else (merged[k], r)
                merged[k] = winner._replace(alternatives="\x1f".join(x for x in (winner.alternatives, loser.text) if x))
            elif {merged[k].script, r.script} == {"ur", "en"}:
                merged[k] = merged[k]._replace(text=f"{merged[k].text} | {r.text}", script="mixed", confidence=max(merged[k].confidence, r.confidence))
            elif r.confidence > merged[k].confidence:
                merged[k] = r
        merged.sort(key=lambda r: ((r.y0 + r.y1) / 2, r.x0))
        out = []
        for r in merged:
            if not any(over(r, s) > 0.75 and likeness(r.text, s.text) > 0.92 for s in out):
                out.append(r)
        return pd.DataFrame([(r.frame, k, r.text, r.confidence, r.script, [x for x in r.alternatives.split("\x1f") if x]) for k, r in enumerate(out)], columns=["frame", "pos", "text", "confidence", "script", "alternatives"])

    return lines.groupBy("frame").applyInPandas(fold, f"frame {dict(lines.dtypes)['frame']}, pos long, text string, confidence double, script string, alternatives array<string>")
