"""Signed page cursors, the outbox's leases, and translation by memory and engine."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Of the outbox's retries.
LONGEST_DELAY, LARGEST_POWER = 300, 8
#: Texts that an engine gets at once.
ENGINE_BATCH = 8


def _hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC by its definition, of two native digests; `message` is binary."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(k ^ x for k in key).hex()))
    return F.unhex(F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256))


def cursor(timestamp: Column, identifier: Column, secret: str) -> Column:
    """A cursor (URL-safe base64 of a JSON body and its signature) for each row. Timestamps are of UTC."""
    micros = F.date_format(timestamp, "SSSSSS")
    iso = F.concat(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))
    body = F.concat(F.lit('{"t":"'), iso, F.lit('","i":"'), identifier.cast("string"), F.lit('"}')).cast("binary")
    signed = F.base64(F.concat(body, F.lit(b"."), _hmac_sha256(secret.encode(), body)))
    return F.translate(signed, "+/=\r\n", "-_")


def read_cursor(value: str, secret: str) -> tuple[datetime, str]:
    """The timestamp and identifier of a cursor; ValueError where it is malformed or signed otherwise."""
    try:
        raw = base64.urlsafe_b64decode(value.encode("ascii") + b"=" * (-len(value) % 4))
        body, dot, signature = raw[:-33], raw[-33:-32], raw[-32:]
        if dot != b"." or not hmac.compare_digest(signature, hmac.new(secret.encode(), body, hashlib.sha256).digest()):
            raise ValueError("signature")
        found = json.loads(body)
        at = datetime.fromisoformat(found["t"])
        return at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc), str(found["i"])
    except (ValueError, KeyError, TypeError, UnicodeError) as error:
        raise ValueError("the cursor is invalid") from error


def claim(outbox: DataFrame, now: Column, limit: int, seconds: int, owner: str, order: list[str]) -> DataFrame:
    """The outbox's next deliveries, with a lease: not published, not given up, due, and under no lease that still runs."""
    free = F.col("leased_until").isNull() | (F.col("leased_until") < now)
    due = outbox.where(F.col("published_at").isNull() & F.col("dead_lettered_at").isNull() & (F.col("available_at") <= now) & free)
    return due.orderBy(*order).limit(limit).withColumns({"leased_until": F.timestamp_seconds(F.unix_micros(now) / 1_000_000 + seconds), "lease_owner": F.lit(owner)})


def settle(claimed: DataFrame, now: Column) -> DataFrame:
    """Deliveries after their attempt (`error`, null where it went through): published, due again later, or given up."""
    failed, attempts = F.col("error").isNotNull(), F.col("attempts") + 1
    over = failed & (attempts >= F.col("max_attempts"))
    delay = F.least(F.lit(LONGEST_DELAY), F.pow(F.lit(2), F.least(attempts, F.lit(LARGEST_POWER))).cast("int"))
    return claimed.withColumns({
        "published_at": F.when(~failed, now).otherwise(F.col("published_at")),
        "dead_lettered_at": F.when(over, now).otherwise(F.col("dead_lettered_at")),
        "available_at": F.when(failed & ~over, F.timestamp_seconds(F.unix_micros(now) / 1_000_000 + delay)).otherwise(F.col("available_at")),
        "attempts": F.when(failed, attempts).otherwise(F.col("attempts")),
        "last_error": F.when(failed, F.substring("error", 1, 4000)),
        "leased_until": F.lit(None).cast("timestamp"),
        "lease_owner": F.lit(None).cast("string"),
    })


def translate_missing(rows: DataFrame, memory: DataFrame, engine: Callable[[list[str], str, str], list[str]]) -> tuple[DataFrame, DataFrame]:
    """(`rows` with translated and cached, the memory with what is new) of rows (text, source, target).

    Equal texts of one pair of languages go to the engine once, in batches of `ENGINE_BATCH`; null and blank texts never
    and stay without a translation. The memory (key, translated) has one row a key. `engine` runs on executors.
    """
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    key = F.sha2(F.concat_ws("\0", F.concat_ws(">", "source", "target"), clean), 256)
    keyed = rows.withColumn("_key", F.when(clean != "", key)).withColumn("_text", clean)
    known = memory.select(F.col("key").alias("_key"), F.col("translated").alias("_known"))
    wanted = keyed.where(F.col("_key").isNotNull()).groupBy("_key", "source", "target", "_text").agg(F.count(F.lit(1)).alias("_n")).join(known, "_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (source, target), group in batch.groupby(["source", "target"], sort=False):
                for k in range(0, len(group), ENGINE_BATCH):
                    part = group.iloc[k : k + ENGINE_BATCH]
                    out += zip(part["_key"], engine(part["_text"].tolist(), source, target), strict=True)
            yield pd.DataFrame(out, columns=["key", "translated"])

    new = wanted.select("_key", "source", "target", "_text").mapInPandas(run, "key string, translated string")
    full = memory.select("key", "translated").unionByName(new)
    found = keyed.join(known, "_key", "left").join(new.withColumnsRenamed({"key": "_key", "translated": "_new"}), "_key", "left")
    return found.withColumns({"translated": F.coalesce("_known", "_new"), "cached": F.col("_known").isNotNull()}).drop("_key", "_text", "_known", "_new"), full


def static_engine(table: dict[tuple[str, str, str], str]) -> Callable[[list[str], str, str], list[str | None]]:
    """An engine that looks up (source, target, text), for tests; None for what it does not know."""
    return lambda texts, source, target: [table.get((source, target, t)) for t in texts]


def taxonomy_rows(categories: DataFrame, critical: list[str], high: list[str], ambiguous: list[str]) -> tuple[DataFrame, DataFrame]:
    """(category dimension, term dimension) of nested categories (id, position, context, terms: map of language to terms).

    A category's priority falls by 3 with its position, from 90 to 10. A term counts once by category, language and
    normalised form (the first one given stays); it needs context where it is ambiguous or more than one category owns it.
    """
    from tessera.functions import text as T

    dimension = categories.select("id", "position", F.greatest(F.lit(10), 90 - 3 * F.col("position")).alias("priority"), "context")
    named = categories.select("id", "context", F.explode("terms").alias("language", "_terms")).select("id", "context", "language", F.posexplode("_terms").alias("_at", "term"))
    named = named.withColumn("normalised", T.normalised_term("term", "language"))
    once = named.groupBy("id", "language", "normalised").agg(F.min_by("term", "_at").alias("term"), F.first("context").alias("context"))
    owners = once.groupBy("language", "normalised").agg(F.count(F.lit(1)).alias("owners"))
    among = lambda words: F.col("normalised").isin(*{T.term(w, lang) for w in words for lang in ("en", "ur")})
    needs = among(ambiguous) | (F.col("owners") > 1)
    none = F.array().cast("array<string>")
    terms = once.join(owners, ["language", "normalised"]).select("id", "language", "normalised", "term", F.when(among(critical), "critical").when(among(high), "high").otherwise("normal").alias("priority"), needs.alias("requires_context"), F.when(needs, F.coalesce("context", none)).otherwise(none).alias("context_terms"))
    return dimension, terms
