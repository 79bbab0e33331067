"""SentencePiece encoding and decoding by weighted finite-state transducers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
#: A model file: a setting of the session, or this.
SETTING, MODEL = "spark.spanworks.pieces.model", "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks whose paths, and pairs of pieces whose costs, a worker remembers.
REMEMBERED, PAIRS = 500_000, 1_000_000

_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6
_INFINITE = float("inf")
#: Above all characters: makes codes of characters (below 0) and pieces positive.
_SHIFT = 0x110002


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and normaliser options of a model file; bounded by its vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, trainer = model.normalizer_spec, model.trainer_spec
    kinds = [p.type for p in model.pieces]
    if trainer.treat_whitespace_as_suffix or trainer.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models with blanks before words are supported")
    if trainer.model_type == 2 and (_USER in kinds or _UNUSED in kinds):
        raise ValueError("BPE models with user-defined or unused pieces are not supported")
    return {
        "pieces": [p.piece for p in model.pieces], "scores": [p.score for p in model.pieces], "kinds": kinds, "map": spec.precompiled_charsmap,
        "bpe": trainer.model_type == 2, "prefix": spec.add_dummy_prefix, "squeeze": spec.remove_extra_whitespaces, "escape": spec.escape_whitespaces}


def normal_forms(blob: bytes) -> dict[str, str]:
    """The rules of a normalisation map, what is read and what is written. The map is a double-array trie over UTF-8 (an
    offset, a label and a leaf mark in each unit of 32 bits), after its size in bytes, and the texts to write after it."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, np.uint32, size // 4, 4).tolist(), blob[4 + size :]
    onward = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    rules, open_ = {}, [(onward(units[0]), b"")]
    while open_:
        base, read = open_.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            child, now = at ^ onward(units[at]), read + bytes([byte])
            if units[at] & 0x100:
                start = units[child] & 0x7FFFFFFF
                rules[now.decode()] = texts[start : texts.index(b"\0", start)].decode()
            open_.append((child, now))
    return rules


class Transducer:
    """Normaliser, pieces and byte fallback, compiled from a model and composed with one text after another.

    The normaliser reads the longest run that a rule of the model's map has and writes the rule's text; what no rule reads
    it copies. The piece transducer reads a run of characters and writes the piece, at the cost of its negative score; the
    fallback transducer reads a character that is no piece and writes the pieces of its bytes. Composed with a text they
    give a lattice, whose tropical shortest path is the encoding. For a BPE model the scores are the order of merging,
    which costs of single pieces can't express; there one more acceptor is composed, over pairs: a piece after another
    costs nothing if merging the two texts would leave that pair as it is, and infinitely much otherwise. All arcs are
    relaxed; of the states of a place (its last pieces) only one has a finite cost, as merging has one outcome, so a state
    a place is kept. The costs of pairs are compiled as they are met, and at most PAIRS of them remembered.
    Texts are cut before blanks first and, if no piece of the model crosses that, between Latin letters and all else; the
    paths of chunks are remembered.
    """

    def __init__(self, model: dict):
        self.model, pieces = model, model["pieces"]
        self.ids = {p: i for i, (p, kind) in enumerate(zip(pieces, model["kinds"])) if kind in (_NORMAL, _USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(pieces, model["kinds"])) if kind == _BYTE}
        self.unknown = next((i for i, kind in enumerate(model["kinds"]) if kind == _UNKNOWN), 0)
        self.rank = {p: model["scores"][i] for p, i in self.ids.items()}
        normal = [s for s, kind in zip(model["scores"], model["kinds"]) if kind == _NORMAL] or [0.0]
        # The largest score a character, less a little, is what a user-defined piece has; an unknown character is far below all.
        self.arc = [-s if kind != _USER else 0.1 - len(p) * max(normal) for p, s, kind in zip(pieces, model["scores"], model["kinds"])]
        self.arc_unknown = 10.0 - min(normal)
        self.tails = {p[i:]: -1 for p in self.ids for i in range(1, len(p))} | self.ids
        self.pairs: dict[int, float] = {}
        self.states: tuple = ("", [-1], [-1], [0.0], [-1 + _SHIFT << 22])
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kind = np.uint16 if len(pieces) <= 1 << 16 else np.uint32
        self.rules = normal_forms(model["map"])
        self.rules |= {p: p for p, kind in zip(pieces, model["kinds"]) if kind == _USER} if self.rules else {}
        self.longest = max(map(len, self.rules), default=0)
        self.begins = re.compile("[" + "".join(map(re.escape, sorted({r[0] for r in self.rules}))) + "]") if self.rules else None
        latin = re.compile("[A-Za-z\u00c0-\u024f]")
        inner = [(a, b) for p in self.ids for a, b in zip(p, p[1:]) if a != SPACE]
        if any(b == SPACE for _, b in inner):
            raise ValueError("pieces with a blank after another character are not supported")
        mixed = any(bool(latin.match(a)) != bool(latin.match(b)) for a, b in inner)
        self.chunk = re.compile(rf"{SPACE}*[^{SPACE}]*" if mixed else rf"{SPACE}*(?:{latin.pattern}+|[^{SPACE}{latin.pattern[1:]}+)|{SPACE}+")
        self.surface = [bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(SPACE, " ").encode() if kind in (_NORMAL, _USER) else " ⁇ ".encode() if kind == _UNKNOWN else b"" for p, kind in zip(pieces, model["kinds"])]

    def mapped(self, text: str) -> str:
        """The text as the map's rules rewrite it, the longest run first."""
        out, done = [], 0
        found = self.begins.search(text)
        while found:
            at = found.start()
            n = next((n for n in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + n] in self.rules), 0)
            out += [text[done:at], self.rules[text[at : at + n]] if n else text[at]]
            done = at + max(n, 1)
            found = self.begins.search(text, done)
        return "".join([*out, text[done:]])

    def normalised(self, text: str) -> str:
        if self.begins:
            text = self.mapped(text)
        if self.model["squeeze"]:
            text = re.sub(" +", " ", text.strip(" "))
        if self.model["prefix"] and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.model["escape"] else text

    def stands(self, a: str, b: str) -> bool:
        """Whether merging the joint text, pair by pair of the best score, the leftmost first, leaves a beside b."""
        rank, parts, border = self.rank.get, [*a, *b], len(a)
        scores = [rank(x + y) for x, y in zip(parts, parts[1:])]  # None: no piece
        while True:
            best, at = None, -1
            for i, score in enumerate(scores):
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return len(parts) == (2 if border else 1)
            if at + 1 == border:  # a pair across the border
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            border -= at + 1 < border
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1])
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at])

    def text_of(self, piece: int) -> str:
        return self.model["pieces"][piece] if piece >= 0 else chr(-2 - piece) if piece < -1 else ""

    def pair_cost(self, a: int, b: int) -> float:
        """The pair acceptor: the cost of b after a (-1: at the start); below -1 are characters that are no piece."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[(a + _SHIFT << 22) + b] = 0.0 if self.stands(self.text_of(a), self.text_of(b)) else _INFINITE
        return found

    def shortest(self, run: str) -> list[int]:
        """The shortest path over a run of characters. Pieces that end at a place are found from their last character on,
        as far as what is read ends any piece. The states of the places that the run shares with the run before are taken
        from there."""
        tail, pair, arc, bpe = self.tails.get, self.pairs.get, self.arc, self.model["bpe"]
        n = len(run)
        before_run, last, back, cost, code = self.states
        shared = 0
        for a, b in zip(run, before_run):
            if a != b:
                break
            shared += 1
        last = last[: shared + 1] + [-1] * (n - shared)
        back = back[: shared + 1] + [-1] * (n - shared)
        cost = cost[: shared + 1] + [_INFINITE] * (n - shared)
        code = code[: shared + 1] + [0] * (n - shared)
        self.states = run, last, back, cost, code
        for end in range(shared + 1, n + 1):
            start = end - 1
            piece, least, best, best_start = tail(run[start]), _INFINITE, -1, -1
            if piece is None or piece < 0:
                best, best_start, least = -2 - ord(run[start]), start, cost[start] + self.arc_unknown
                if bpe:
                    joint = pair(code[start] + best)
                    least += self.pair_cost(last[start], best) if joint is None else joint
            while bpe and piece is not None:
                if piece >= 0:
                    joint = pair(code[start] + piece)
                    if joint is None:
                        joint = self.pair_cost(last[start], piece)
                    if not joint:  # else infinite, which is never the least
                        total = cost[start] + arc[piece]
                        if total <= least:
                            least, best, best_start = total, piece, start
                if not start:
                    break
                start -= 1
                piece = tail(run[start:end])
            while not bpe and piece is not None:
                if piece >= 0:
                    total = cost[start] + arc[piece]
                    if total <= least:
                        least, best, best_start = total, piece, start
                if not start:
                    break
                start -= 1
                piece = tail(run[start:end])
            cost[end], last[end], back[end], code[end] = least, best, best_start, best + _SHIFT << 22
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def path(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.shortest(chunk):
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-2 - piece).encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The encodings of texts. New chunks are taken in order, so that neighbours share states. Paths of short chunks
        are kept among the recent ones; when those are many they become the older ones, and the older ones go unless
        they are met again."""
        cut = [self.chunk.findall(self.normalised(t)) for t in texts]
        if len(self.recent) >= REMEMBERED:
            self.recent, self.older = {}, self.recent
        recent, older, long = self.recent, self.older, {}
        for chunk in sorted(set().union(*cut).difference(recent)):
            found = older.get(chunk)
            if found is None:
                found = np.array(self.path(chunk), self.kind).tobytes()
            (recent if len(chunk) < 64 else long)[chunk] = found
        get = (lambda c: recent[c] if c in recent else long[c]) if long else recent.__getitem__
        return [self.joined(np.frombuffer(b"".join(map(get, chunks)), self.kind)) for chunks in cut]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Unknown characters in a row are one unknown piece, if there are no pieces of bytes."""
        if self.bytes:
            return ids
        bare = ids == self.unknown
        return ids[~(bare & np.r_[False, bare[:-1]])] if bare.any() else ids

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model["prefix"] and text.startswith(" ") else text


_compiled: dict[str, Transducer] = {}


def model_path(spark) -> str:
    return spark.conf.get(SETTING, MODEL)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, n_pieces, n_bytes (pieces of byte fallback), round_trip (whether
    decoding gives the text again; U+2581 in a text decodes to a blank), ids.

    Null texts have null ids and round_trip and counts 0; empty texts no ids. Rows that repeat a doc_id each get a row.
    An empty table gives no rows. Other columns are not read. path names a model file the driver can read (SETTING of the
    session, else MODEL); what the workers need of it is sent to them, bounded by its vocabulary. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(path or model_path(docs.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _compiled.get("last")  # a worker serves many tasks
        if transducer is None or transducer.model != sent.value:
            transducer = _compiled["last"] = Transducer(sent.value)
        is_byte = np.zeros(len(transducer.surface), bool)
        is_byte[list(transducer.bytes.values())] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                missing = np.array([t is None for t in texts])
                ids = transducer.encode_all([t or "" for t in texts])
                trips = [None if t is None else transducer.decode(x.tolist()) == t for t, x in zip(texts, ids)]
                counts = np.array([len(x) for x in ids], np.int64)
                ends, flat = np.concatenate(([0], np.cumsum(counts))).astype(np.int32), np.concatenate(ids).astype(np.int32)
                bytes_before = np.concatenate(([0], np.cumsum(is_byte[flat])))
                columns = [
                    part.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(counts), pa.array(bytes_before[ends[1:]] - bytes_before[ends[:-1]], pa.int64()),
                    pa.array(trips, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(missing))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_pieces", "n_bytes", "round_trip", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, n_pieces long, n_bytes long, round_trip boolean, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the pieces' texts, bytes joined to characters (U+FFFD where they make none).
    Null ids give a null text, no ids an empty one. Rows that repeat a doc_id each get a row. An empty table gives no
    rows. Other columns are not read. Nothing is shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(read_model(path or model_path(rows.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(sent.value)
        for batch in batches:
            texts = [None if ids is None else transducer.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
