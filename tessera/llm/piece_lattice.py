"""SentencePiece encoding and decoding (operator 10): N-best segmentation over the piece lattice.

The forward Viterbi scores of a lattice are the exact heuristic of a backward A-star search, which yields segmentations
best first. A text's lattice falls apart wherever no piece spans two neighbouring characters; each part is searched
once and remembered, and the text's N best are the best sums over its parts.

The pieces come from a public SentencePiece model (path: a parameter). Its scores are merge ranks; Zipf's law turns a
rank into a log probability. Characters without a piece are spelt as byte pieces, so that decoding gives every text back.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, read

MODEL, NBEST = "/opt/tokenizers/piece_bpe_32k.model", 3
SPACE = "▁"
#: A text's own U+2581 is spelt as bytes; in the lattice a private character stands for it, which is spelt as bytes too.
_STAND_IN = "\U0010fffe"
_LITERAL = {_STAND_IN: SPACE}
#: Parts remembered at most in a worker; then it starts anew.
REMEMBERED = 150_000
#: Texts whose new parts are searched together.
TEXTS = 256
#: Longer parts are searched each time.
LONGEST = 48
#: Scores are whole hundred-thousandths, so that sums do not depend on their order.
SCALE = 100_000
#: A byte piece costs this many times the rarest piece's cost.
BYTE_COST = 1.5

#: (score, ids as int32 bytes, loss of the second best or NEVER): what is remembered of a part.
Part = tuple[int, bytes, int]
NEVER = 1 << 60
#: Numbers in a block of the batched search.
CELLS = 120_000
_P = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
#: Below every score of a part of up to 10 ** 9 characters; two of them fit 64 bits.
_LOST = -(1 << 61)


class Lattice:
    def __init__(self, proto: bytes, nbest: int = NBEST) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.nbest, self.size = nbest, sp.vocab_size()
        self.raw: list[bytes] = [b""] * self.size
        self.byte_ids = [0] * 256
        ranked = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ranked.append((-sp.get_score(i), i, piece))
                self.raw[i] = piece.replace(SPACE, " ").encode()
        ranked.sort()
        total = math.log(sum(1 / k for k in range(1, len(ranked) + 1)))
        self.pieces = {piece: (i, -round(SCALE * (math.log(k + 1) + total))) for k, (_, i, piece) in enumerate(ranked)}
        self.byte_score = -round(SCALE * BYTE_COST * (math.log(len(ranked) + 1) + total))
        self.longest = max(map(len, self.pieces), default=1)
        self.joined = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        # A part: spaces, ASCII marks, other characters; cut before marks unless a piece joins the first of them to what
        # stands before. A line break is in no longer piece.
        alone = "" if any("\n" in x for x in self.joined) else "\n"
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum())
        before: dict[str, set[str]] = {}
        for x in self.joined:
            if x[0] != SPACE and (x[0].isalnum() or ord(x[0]) > 126) and 32 < ord(x[1]) < 127 and not x[1].isalnum():
                before.setdefault(x[1], set()).add(x[0])
        on = "|".join(f"(?<=[{''.join(map(re.escape, sorted(left)))}]){re.escape(c)}" for c, left in sorted(before.items()))
        other = rf"[^ {alone}{marks}]"
        self.cut = re.compile(rf"{alone + '|' if alone else ''} *[{marks}]*{other}+" + (rf"(?:(?:{on})[{marks}]*{other}*)*" if on else "") + rf"| *[{marks}]+| +")
        self.apart = not any(x[1] == SPACE and x[0] != SPACE for x in self.joined)
        self.known: dict[str, Part] = {}
        self._fill_table()

    def _fill_table(self) -> None:
        """An open hash table of all prefixes of pieces: by hash, the piece there (or -1) and whether longer ones go on."""
        keys, ids, scores, longer = [], [], [], []
        on = {p[:-1] for p in self.prefixes if len(p) > 1}
        for p in sorted(self.prefixes):
            h = 0
            for c in p:
                h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            i, score = self.pieces.get(p, (-1, 0))
            keys.append(h)
            ids.append(i)
            scores.append(score)
            longer.append(p in on)
        self.slot_key = np.zeros(1 << _TABLE_BITS, np.uint64)
        self.slot_at = np.full(1 << _TABLE_BITS, -1, np.int32)
        for at, h in enumerate(keys):
            slot = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> (64 - _TABLE_BITS)
            while self.slot_at[slot] >= 0:
                slot = (slot + 1) & ((1 << _TABLE_BITS) - 1)
            self.slot_key[slot], self.slot_at[slot] = h, at
        self.entry_id, self.entry_score, self.entry_longer = np.array(ids, np.int32), np.array(scores, np.int32), np.array(longer)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where it is no prefix of a piece."""
        slot = (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        out = self.slot_at[slot]
        wrong = np.flatnonzero((out >= 0) & (self.slot_key[slot] != h))
        while len(wrong):
            slot = (slot + 1) & ((1 << _TABLE_BITS) - 1)
            out[wrong] = self.slot_at[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.slot_key[slot[wrong]] != h[wrong])]
        return out

    def learn(self, parts: list[str]) -> None:
        """Search many parts at once: forward Viterbi, then the backward walk of A-star along the best path.

        With exact heuristics the walk never leaves the best path; what it puts aside there holds the second best.
        """
        parts, start = sorted(parts, key=len), 0
        while start < len(parts):
            end = start + 1
            while end < len(parts) and (end + 1 - start) * (len(parts[end]) + 1) * self.longest <= CELLS:
                end += 1
            self._learn_block(parts[start:end])
            start = end

    def _learn_block(self, parts: list[str]) -> None:
        n, size = len(parts), len(parts[-1])
        width = min(self.longest, size)
        spelt = "".join([p.replace(SPACE, _STAND_IN).replace(" ", SPACE).ljust(size, "\0") for p in parts])
        codes = np.frombuffer(spelt.encode("utf-32-le"), np.uint32).reshape(n, size)
        lens = np.fromiter(map(len, parts), np.int64, n)
        # by part, end and width - length: longest first
        score = np.full((n, size + 1, width), _LOST, np.int64)
        ids = np.zeros((n, size + 1, width), np.int32)
        row, at = np.nonzero(np.arange(size) < lens[:, None])
        h = np.zeros(len(row), np.uint64)
        for k in range(1, width + 1):
            h = h * _P + (codes[row, at + k - 1].astype(np.uint64) + np.uint64(1))
            entry = self._find(h)
            piece = np.where(entry >= 0, self.entry_id[entry], -1)
            good = piece >= 0
            score[row[good], at[good] + k, width - k] = self.entry_score[entry[good]]
            ids[row[good], at[good] + k, width - k] = piece[good]
            if k == 1:
                code = codes[row[~good], at[~good]]
                long = np.where(code == ord(_STAND_IN), 3, 1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF))
                score[row[~good], at[~good] + 1, width - 1] = self.byte_score * long
                ids[row[~good], at[~good] + 1, width - 1] = -1 - code.astype(np.int64)
            go = (entry >= 0) & self.entry_longer[entry] & (at + k < lens[row])
            row, at, h = row[go], at[go], h[go]
        best = np.full((n, size + 1 + width), _LOST, np.int64)  # shifted by width: best[:, width] is the start
        best[:, width] = 0
        choice, aside = np.zeros((n, size + 1), np.int64), np.zeros((n, size + 1), np.int64)
        every = np.arange(n)
        for b in range(1, size + 1):
            ahead = best[:, b : b + width] + score[:, b]
            top = ahead.argmax(1)
            first = ahead[every, top]
            ahead[every, top] = 2 * _LOST
            best[:, width + b], choice[:, b] = np.maximum(first, _LOST), top
            aside[:, b] = first - np.maximum(ahead.max(1), _LOST)
        pos, loss, path = lens.copy(), np.full(n, -_LOST, np.int64), []
        while (live := pos > 0).any():
            top = choice[every, pos]
            loss = np.where(live, np.minimum(loss, aside[every, pos]), loss)
            path.append((np.where(live, ids[every, pos, top], 0), live))
            pos = np.where(live, pos - (width - top), 0)
        total = best[every, width + lens].tolist()
        steps, taken = np.array([x[0] for x in path[::-1]]).T, np.array([x[1] for x in path[::-1]]).T
        flat, plain = steps.astype(np.int32), (steps < 0).any(1).tolist()
        counts = taken.sum(1)
        packed, begin = flat[taken].tobytes(), (np.cumsum(counts) - counts).tolist()
        counts, loss = counts.tolist(), loss.tolist()
        for k, part in enumerate(parts):
            if plain[k]:
                out = np.array([i for x, y in zip(steps[k].tolist(), taken[k].tolist(), strict=True) if y for i in ((x,) if x >= 0 else self._bytes(chr(-1 - x)))], np.int32).tobytes()
            else:
                out = packed[4 * begin[k] : 4 * (begin[k] + counts[k])]
            self.known[part] = (total[k], out, loss[k] if loss[k] < -_LOST // 2 else NEVER)

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[x] for x in _LITERAL.get(char, char).encode())

    def arcs(self, text: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """By end position: (start, ids, score) of every piece there, and of the bytes of a character without one."""
        n, ends = len(text), [[] for _ in range(len(text) + 1)]
        pieces, prefixes = self.pieces, self.prefixes
        for a in range(n):
            single = False
            for b in range(a + 1, min(n, a + self.longest) + 1):
                key = text[a:b]
                if key not in prefixes:
                    break
                if found := pieces.get(key):
                    ends[b].append((a, (found[0],), found[1]))
                    single |= b == a + 1
            if not single:
                spelt = self._bytes(" " if text[a] == SPACE else text[a])
                ends[a + 1].append((a, spelt, self.byte_score * len(spelt)))
        return ends

    def search(self, text: str) -> list[tuple[int, tuple[int, ...]]]:
        """The `nbest` best segmentations of a part; of equals, that whose last pieces came first is first."""
        ends, n = self.arcs(text), len(text)
        best = [0] * (n + 1)
        for b in range(1, n + 1):
            best[b] = max([best[a] + s for a, _, s in ends[b]])
        heap, count, found = [(-best[n], 0, n, 0, ())], 1, []
        while heap and len(found) < self.nbest:
            f, _, at, gone, path = heapq.heappop(heap)
            while at:  # the best way on is followed at once, the others wait
                arcs = ends[at]
                if len(arcs) > 1:
                    top = -f - gone
                    ahead = None
                    for arc in arcs:
                        h = best[arc[0]] + arc[2]
                        if h == top and ahead is None:
                            ahead = arc
                        else:
                            heapq.heappush(heap, (-(h + gone), count, arc[0], gone + arc[2], (arc[1], path)))
                            count += 1
                else:
                    ahead = arcs[0]
                gone, path, at = gone + ahead[2], (ahead[1], path), ahead[0]
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((f, tuple(ids)))
        return [(-f, ids) for f, ids in found]

    def parts(self, text: str) -> list[str]:
        """The text's parts in order, with the space that SentencePiece puts in front; long ones are cut further."""
        if not text:
            return []
        found = self.cut.findall(" " + text) if self.apart else [" " + text]
        if max(map(len, found)) <= LONGEST:
            return found
        out = []
        for p in found:
            if len(p) <= LONGEST:
                out.append(p)
            else:
                spelt = p.replace(SPACE, _STAND_IN).replace(" ", SPACE)
                cuts = [0, *[k for k in range(1, len(p)) if spelt[k - 1 : k + 1] not in self.joined], len(p)]
                out += [p[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def best(self, parts: list[str]) -> list[tuple[int, np.ndarray]]:
        """(score, ids) of the N best of known parts in a row.

        Only the N - 1 parts with the lowest losses can differ from their best in one of them; those are searched
        for their alternatives, and the best sums are taken.
        """
        held = [self.known[p] for p in parts]
        score, pieces = sum([x[0] for x in held]), [x[1] for x in held]
        out = [(score, np.frombuffer(b"".join(pieces), np.int32))]
        losses, order = [x[2] for x in held], []
        for _ in range(min(self.nbest - 1, len(losses))):
            low = min(losses)
            if low >= NEVER:
                break
            order.append(losses.index(low))
            losses[order[-1]] = NEVER
        if not order:
            return out
        order.sort()
        options = []
        for k in order:
            found = self.search(parts[k].replace(SPACE, _STAND_IN).replace(" ", SPACE))
            options.append([(0, pieces[k]), *((found[0][0] - s, np.array(ids, np.int32).tobytes()) for s, ids in found[1:])])
        start = (0,) * len(order)
        heap, seen = [(0, start)], {start}
        while heap and len(out) < self.nbest:
            loss, pick = heapq.heappop(heap)
            if pick != start:
                changed = pieces.copy()
                for k, choice, option in zip(order, pick, options, strict=True):
                    changed[k] = option[choice][1]
                out.append((score - loss, np.frombuffer(b"".join(changed), np.int32)))
            for j in range(len(pick)):
                if pick[j] + 1 < len(options[j]):
                    step = (*pick[:j], pick[j] + 1, *pick[j + 1 :])
                    if step not in seen:
                        seen.add(step)
                        heapq.heappush(heap, (loss - options[j][pick[j]][0] + options[j][pick[j] + 1][0], step))
        return out

    def encode(self, texts: list[str | None]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """The N best of each whole text, best first; a text without a character has one, without pieces."""
        for start in range(0, len(texts), TEXTS):
            parted = [self.parts(t or "") for t in texts[start : start + TEXTS]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            if new := set(chain.from_iterable(parted)) - self.known.keys():
                self.learn(list(new))
            yield from map(self.best, parted)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


_open: dict[tuple[int, int], Lattice] = {}


def lattice(proto: bytes | None = None, nbest: int = NBEST) -> Lattice:
    """A worker's lattice of a model (its bytes; None: of MODEL), made once, as long as no other operator works there."""
    proto = Path(MODEL).read_bytes() if proto is None else proto
    claim("piece_lattice", _open.clear)
    key = zlib.crc32(proto), nbest
    if key not in _open:
        _open[key] = Lattice(proto, nbest)
    return _open[key]


def _shipped(df: DataFrame, model: str):
    """The model's bytes for the executors, which need not have the file: half a megabyte, whatever the tables hold."""
    return df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())


SCHEMA = "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, score double, nbest_scores array<double>, nbest_pieces array<int>, round_trip boolean"


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """One row per row of `docs`: the best segmentation's ids and score, scores and lengths of the N best, and
    round_trip: whether the best decodes to the whole text.

    Null and empty texts have no pieces, score 0 and one (empty) segmentation. Repeated rows are alike; an empty table
    gives no rows; other columns are left out. Whole texts are encoded; what a worker remembers is bounded.
    """

    proto = _shipped(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lattice(proto.value, nbest)
        for batch in batches:
            ids, crc, score, scores, lengths, back = [], [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for value, found in zip(texts, at.encode(texts), strict=True):
                first = found[0][1]
                ids.append(first)
                crc.append(zlib.crc32(first.tobytes()))
                score.append(found[0][0] / SCALE)
                scores.append([x[0] / SCALE for x in found])
                lengths.append([len(x[1]) for x in found])
                back.append(at.decode(first.tolist()) == (value or ""))
            names = ["doc_id", "n_pieces", "ids", "ids_crc32", "score", "nbest_scores", "nbest_pieces", "round_trip"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(crc, pa.int64()), pa.array(score, pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(lengths, pa.list_(pa.int32())), pa.array(back, pa.bool_())], names
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): null ids give null, empty ids the empty text; a null doc_id is a value like others.

    Repeated rows are alike; an empty table gives no rows; other columns are left out.
    """
    proto = _shipped(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lattice(proto.value, nbest)
        for batch in batches:
            texts = [None if x is None else at.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))


QUERIES = {"op10_piece_lattice": op10_piece_lattice}
ORACLES: dict[str, str] = {}
