"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

A merge list decides how far to the right of a cut text can still change the tokens left of it. That
lookahead is computed once (`MergeTable.lookahead`). The transducer then holds only a window of bytes: it
merges the window and emits the tokens that end at least one lookahead before the window's end, since no
later text can change them. So a run of any length is encoded in constant memory. Decoding feeds bytes to
an incremental UTF-8 machine that keeps at most three of them.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ionlake.llm.common import text_of

#: The published pattern of the byte-level vocabulary.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A piece ends wherever white space follows something else; searched from the right.
_CUT = regex.compile(r"(?r)(?<=\S)(?=\s)")
_RUNS = {"letter": regex.compile(r"\p{L}+"), "digit": regex.compile(r"\p{N}+"), "other": regex.compile(r"[^\s\p{L}\p{N}]+"), "space": regex.compile(r"\s+")}

BLOCK = 1 << 15
CACHED_CHARS, CACHED_PIECES, SHORT = 40, 300_000, 48


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: visible Latin-1 stands for itself, the rest follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Merges by rank, the bytes of each id, the special strings and the sufficient lookahead."""

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        model, stand_in = parsed["model"], byte_alphabet()
        self.vocab: dict[str, int] = model["vocab"]
        self.byte_ids = [self.vocab[stand_in[b]] for b in range(256)]
        self.text_id = {chr(b): i for b, i in enumerate(self.byte_ids)}
        self.special = {x["content"]: x["id"] for x in parsed.get("added_tokens", [])}
        back = {c: b for b, c in stand_in.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in self.vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.text_bytes = {str(i): b for i, b in self.bytes_of.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if (ids := (self.vocab[a], self.vocab[b])) not in self.ranks:
                self.ranks[ids] = len(self.made)
                self.made.append(self.vocab[a + b])
        self.lookahead = self._sufficient_lookahead()
        self.window = max(1024, 8 * self.lookahead)

    def _sufficient_lookahead(self) -> int:
        """Bytes by which the border between equal and unequal tokens can move left of a cut, at most.

        It moves over a token u only where a rule (u, v) applies on one side of the comparison and v starts at
        the border. v then begins with what an earlier rule (x, y) at that border made or left alone: with x or
        xy. So the furthest move is the longest chain of rules, each of higher rank than the last, along which
        the next rule's v has x or xy on its left spine; it counts the bytes of the left parts.
        """
        left: dict[int, int] = {}
        reach: dict[int, int] = {}
        most = 0
        for (u, v), rank in self.ranks.items():
            made = self.made[rank]
            far, spine = 0, v
            while spine is not None:
                far = max(far, reach.get(spine, 0))
                spine = left.get(spine)
            far += len(self.bytes_of[u])
            most = max(most, far)
            reach[u] = max(reach.get(u, 0), far)
            reach[made] = max(reach.get(made, 0), far)
            left.setdefault(made, u)
        return most

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece: always the pair of lowest rank next, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in data]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank_of, made_by, none = self.ranks.get, self.made, len(self.made)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]  # noqa: B905
        left = len(ranks)
        while left:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            made = ids[i] = made_by[least]
            del ids[i + 1], ranks[i]
            left -= 1
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], made), none)
            if i < left:
                ranks[i] = rank_of((made, ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks, made_by = len(ids), self.ranks, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made_by[rank], -1, after[j]
            around = [(before[i], i)] if before[i] >= 0 else []
            if after[i] < n:
                before[after[i]] = i
                around.append((i, after[i]))
            for x, y in around:
                if (r := ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(queue, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Encodes one open run of bytes, emitting each id as soon as it is stable."""

    def __init__(self, table: MergeTable) -> None:
        self.table, self.held = table, b""

    def feed(self, data: bytes) -> list[int]:
        table, out = self.table, []
        for at in range(0, len(data), table.window):
            self.held += data[at : at + table.window]
            if len(self.held) >= table.window:
                stable, end = len(self.held) - table.lookahead, 0
                for i in table.merge(self.held):
                    size = len(table.bytes_of[i])
                    if end + size > stable:
                        break
                    out.append(i)
                    end += size
                self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        rest, self.held = self.held, b""
        return self.table.merge(rest) if rest else []


class Cache:
    """Ids of short pieces and of short words after a space; emptied when full."""

    def __init__(self) -> None:
        self.pieces: dict[str, str] = {}
        self.words: dict[str, str] = {}

    @staticmethod
    def put(into: dict[str, str], key: str, ids: str) -> None:
        if len(key) <= CACHED_CHARS:
            if len(into) >= CACHED_PIECES:
                into.clear()
            into[key] = ids


class StreamEncoder:
    """Text in blocks of any size in, ids as comma-joined strings out. Memory is bounded by the block."""

    def __init__(self, table: MergeTable, cache: Cache | None = None) -> None:
        self.table, self.cache = table, cache or Cache()
        self.text, self.open = "", None

    def _piece(self, piece: str) -> str:
        data = piece.encode()
        if len(data) > self.table.window:
            run = Transducer(self.table)
            ids = run.feed(data) + run.finish()
        else:
            ids = self.table.merge(data)
        known = ",".join(map(str, ids))
        self.cache.put(self.cache.pieces, piece, known)
        return known

    def _pieces(self, pieces: list[str]) -> str:
        known = self.cache.pieces.get
        return ",".join([known(p) or self._piece(p) for p in pieces])

    def _word(self, word: str) -> str:
        """The ids of a space and a word. Letters alone are one piece, with a comma or full stop two."""
        if word.isalpha():
            known = ",".join(map(str, self.table.merge((" " + word).encode())))
        elif word[-1] in ",." and (stem := word[:-1]).isalpha():
            known = f"{self.cache.words.get(stem) or self._word(stem)},{self.table.text_id[word[-1]]}"
        else:
            known = self._pieces(PIECE.findall(" " + word))
        self.cache.put(self.cache.words, word, known)
        return known

    def _words(self, text: str) -> str:
        """Splits at single spaces first: a piece ends before a space that follows no white space."""
        first, *words = text.split(" ")
        found = list(map(self.cache.words.get, words))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    word = words[i]
                    if not word or word[-1].isspace() or len(word) > CACHED_CHARS:
                        return self._pieces(PIECE.findall(text))
                    found[i] = self._word(word)
        if words and (not first or first[-1].isspace()):
            return self._pieces(PIECE.findall(text))
        return ",".join([self._pieces(PIECE.findall(first)), *found] if first else found)

    def _held_back(self, text: str) -> int:
        """Characters at the end that may begin a special string."""
        return max((k for s in self.table.special for k in range(1, len(s)) if text.endswith(s[:k])), default=0)

    def _run(self, text: str, last: bool) -> tuple[list[str], str]:
        """Feeds the open run what belongs to it; gives back the rest."""
        kind, transducer = self.open
        m = _RUNS[kind].match(text)
        end = m.end() if m else 0
        ends = end < len(text) or last
        take = end - 1 if kind == "space" and end and not (last and end == len(text)) else end
        out = [",".join(map(str, transducer.feed(text[:take].encode())))]
        if ends:
            out.append(",".join(map(str, transducer.finish())))
            self.open = None
        return out, text[take:]

    def feed(self, text: str, last: bool = False) -> list[str]:
        """Ids of all that is decided; with ``last``, of all the text."""
        out, rest, self.text = [], self.text + text, ""
        while True:
            at, special = min(((i, s) for s in self.table.special if (i := rest.find(s)) >= 0), default=(-1, ""))
            if at < 0:
                break
            out += self._segment(rest[:at], True)[0]
            out.append(str(self.table.special[special]))
            rest = rest[at + len(special) :]
        done, self.text = self._segment(rest, last)
        return [x for x in out + done if x]

    def _segment(self, text: str, last: bool) -> tuple[list[str], str]:
        out: list[str] = []
        if self.open and (text or last):
            back = 0 if last else self._held_back(text)
            done, rest = self._run(text[: len(text) - back], last)
            out, text = out + done, rest + text[len(text) - back :]
            if self.open:
                return out, text
        if last:
            return [*out, self._words(text)] if text else out, ""
        body = text[: len(text) - self._held_back(text)]
        if cut := _CUT.search(body, 1):
            return [*out, self._words(text[: cut.start()])], text[cut.start() :]
        if len(body) < max(BLOCK, 4):
            return out, text
        pieces = PIECE.findall(body)
        if len(pieces) > 1:  # only the last two pieces can still change, of two only the last
            done = pieces[: max(1, len(pieces) - 2)]
            return [*out, self._pieces(done)], text[sum(map(len, done)) :]
        lead = 1 if body[0] == " " and not _RUNS["space"].match(body, 1) else 0
        kind = next(k for k, p in _RUNS.items() if p.match(body, lead))
        self.open = (kind, Transducer(self.table))
        out.append(",".join(map(str, self.open[1].feed(body[:lead].encode()))))
        done, rest = self._run(body[lead:], False)
        return out + done, rest + text[len(body) :]


class StreamDecoder:
    """Ids in, text out as soon as its bytes are whole; ill-formed bytes become U+FFFD."""

    def __init__(self, table: MergeTable) -> None:
        self.table, self.machine = table, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: str, last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.table.text_bytes.__getitem__, ids.split(","))) if ids else b"", last)


def encode(text: str, table: MergeTable, cache: Cache | None = None) -> Iterator[str]:
    """Comma-joined ids of the text, block after block."""
    encoder = StreamEncoder(table, cache)
    for at in range(0, len(text), BLOCK):
        yield from encoder.feed(text[at : at + BLOCK], at + BLOCK >= len(text))


_LOADED: dict[str, tuple[MergeTable, Cache]] = {}  # of a Python worker, which serves many tasks


def round_trip(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``with_ids`` also ids and decoded.

    ``vocabulary`` is the path of a byte-level BPE file on the driver; its content (of fixed size) is sent to
    the executors. A null or empty text has no tokens. Rows stay rows: equal ids, null ids and repeats are kept.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if spec.value not in _LOADED:
            _LOADED.clear()
            _LOADED[spec.value] = MergeTable(spec.value), Cache()
        table, cache = _LOADED[spec.value]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                count, hashed, read, decoder = 0, hashlib.sha256(), hashlib.sha256(), StreamDecoder(table)
                kept: tuple[list, list] = ([], [])
                for ids in encode(text.as_py(), table, cache):
                    hashed.update((b"," if count else b"") + ids.encode())
                    count += ids.count(",") + 1
                    part = decoder.feed(ids)
                    read.update(part.encode())
                    if with_ids:
                        kept[0].append(ids)
                        kept[1].append(part)
                end = decoder.feed("", True)
                read.update(end.encode())
                rows.append((doc_id, count, hashed.hexdigest(), read.hexdigest(), *((",".join(kept[0]), "".join(kept[1]) + end) if with_ids else ())))
            names = [x.split(" ")[0] for x in schema.split(", ")]
            types = [pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
