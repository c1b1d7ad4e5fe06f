"""BPE encoding and decoding as bounded-memory streaming transducers.

Encoder: text is normalised and cut into words by the vocabulary's rules; a word's
symbols are merged by rank. A word longer than a window is encoded in windows: tokens
that end at least the merge list's lookahead before the window's end can't change any
more and are emitted; the next window starts where they end. Decoder: ids go through a
table of token texts, token after token.

Sufficient lookahead. Rank order applies rule after rule, all occurrences from the left.
Compare a text with a continuation of it. Where their merges differ, there is a leftmost
boundary that differs; it moves left only when a rule (u, v) applies in one of the two
at that boundary, with u to its left. Afterwards a token that begins with u starts at the
new boundary in both, so the next rule that moves it has a larger rank and a right side
that begins with u. The longest sum of |u| along such chains of rules, plus the longest
token (it may reach over the window's end), bounds how far back the end of a window acts.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Characters of text handled at a time, symbols of a window within one word, words whose tokens are remembered.
CHUNK, WINDOW, CACHE = 1 << 16, 4096, 1 << 18


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], end: str) -> int:
    """Symbols before a window's end that may still change (see the module's text)."""
    reach: dict[str, int] = {}
    longest, token = 0, 1
    for u, v in merges:
        v_text, u_len = v.removesuffix(end), len(u)
        back = u_len + max((reach.get(v_text[:n], 0) for n in range(1, len(v_text) + 1)), default=0)
        if back > reach.get(u, 0):
            reach[u] = back
        longest = max(longest, back)
        token = max(token, u_len + len(v_text))
    return longest + token


class Vocabulary:
    """A BPE vocabulary read from a tokenizer file: NFC, white space to one blank, lower case; words by pattern; bytes as symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: r for r, m in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, self.end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.symbols = byte_symbols()
        self.known: dict[str, tuple[int, ...]] = {}

    # --- words -> tokens

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols merged by rank, equal ranks from the left: a queue of pairs over a linked list."""
        n, ranks = len(symbols), self.ranks
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, i + 1) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, j = heapq.heappop(queue)
            a, b = symbols[i], symbols[j]
            if right[i] != j or not a or ranks.get((a, b)) != r:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + b, ""
            k = right[i] = right[j]
            right[j] = -2
            if k >= 0:
                left[k] = i
                if (r := ranks.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, k))
            if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
                heapq.heappush(queue, (r, h, i))
        return [t for t in symbols if t]

    def word_tokens(self, word: str) -> Iterator[str]:
        """Tokens of one word; a long one passes through windows, holding one window at a time."""
        data = word.encode()
        at, size = 0, max(WINDOW, 4 * self.lookahead)
        while len(data) - at > size:
            symbols = [self.symbols[b] for b in data[at:at + size]]
            done = 0
            for t in self.merged(symbols):
                if done + len(t) > size - self.lookahead:
                    break
                yield t
                done += len(t)
            at += done
        symbols = [self.symbols[b] for b in data[at:]]
        if symbols:
            symbols[-1] += self.end
        yield from self.merged(symbols)

    def word_ids(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = tuple(self.ids[t] for t in self.word_tokens(word) if t in self.ids)
            if len(word) <= 64:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[word] = found
        return found

    # --- text -> words

    def normalised(self, text: str) -> str:
        if not text.isascii():
            # each character by itself: the final form of sigma doesn't depend on its place
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> Iterator[str]:
        """Normalised text in pieces that no word crosses: cut at white space after every CHUNK characters."""
        at = 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text):
                cut = _BLANK.search(text, end)
                end = cut.start() if cut else len(text)
            yield self.normalised(text[at:end])
            at = end

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Ids of a text, list after list, each complete."""
        at, text = 0, text or ""
        for mark in self.marks.finditer(text):
            yield from self._plain(text[at:mark.start()])
            yield [self.special[mark.group()]]
            at = mark.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[list[int]]:
        for piece in self.pieces(text):
            known, ids = self.known, []
            for word in self.pattern.findall(piece):
                found = known.get(word)
                ids += self.word_ids(word) if found is None else found
            yield ids


_BLANK = regex.compile(r"\s")


class Decoder:
    """Ids to token texts, one after the other, separated by a blank; unknown ids are left out.

    This is how a tokenizer without a decoder of its own shows ids.

    The state is whether a token came before, so memory doesn't grow with the text.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.texts, self.started = vocabulary.texts, False

    def feed(self, ids: list[int]) -> str:
        out = " ".join([self.texts[i] for i in ids if i in self.texts])
        if out and self.started:
            out = " " + out
        self.started = self.started or bool(out)
        return out


class TextDecoder:
    """Ids to plain text, one after the other: symbols become bytes, word ends blanks, bytes characters.

    A token may end within a character; its first bytes wait in the state until the rest
    comes. ``close`` gives what an unfinished character is read as.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.texts, self.end = vocabulary.texts, vocabulary.end
        self.bytes = {c: b for b, c in enumerate(vocabulary.symbols)}
        self.special = set(vocabulary.special.values())
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        out = []
        for i in ids:
            token = self.texts.get(i, "")
            word_end = bool(self.end) and i not in self.special and token.endswith(self.end)
            token = token.removesuffix(self.end) if word_end else token
            data = token.encode() if i in self.special else bytes(self.bytes[c] for c in token)
            out.append(self.state.decode(data) + (" " if word_end else ""))
        return "".join(out)

    def close(self) -> str:
        return self.state.decode(b"", True)


def _shared(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once by each Python worker."""
    if path not in _READ:
        _READ[path] = Vocabulary(path)
    return _READ[path]


_READ: dict[str, Vocabulary] = {}


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every whole text; null and empty texts have none."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _shared(path)
        for batch in it:
            ids = [[i for part in vocabulary.encode(x.as_py()) for i in part] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _two(df, key, text).mapInArrow(batches, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): the plain text of every list of ids (as normalised); a null list gives an empty text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _shared(path)
        for batch in it:
            texts = []
            for x in batch.column("ids"):
                decoder = TextDecoder(vocabulary)
                texts.append(decoder.feed(x.as_py() or []) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(batches, "doc_id long, text string")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, holding one list of ids at a time.

    ``with_ids`` adds the ids themselves, ``keep`` columns of ``df``. One row for each input row; a null text counts as
    empty. Repeated rows are each encoded; an empty table gives an empty result.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _shared(path)
        for batch in it:
            rows = []
            for x in batch.column("text"):
                all_ids, n, ids_hash, text_hash, decoder = [], 0, hashlib.sha256(), hashlib.sha256(), Decoder(vocabulary)
                for ids in vocabulary.encode(x.as_py()):
                    n += len(ids)
                    ids_hash.update(np.array(ids, dtype="<u4").tobytes())
                    text_hash.update(decoder.feed(ids).encode())
                    all_ids += ids if with_ids else []
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest(), all_ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                 *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)],
                 *([pa.array([r[3] for r in rows], pa.list_(pa.int32()))] if with_ids else []), *map(batch.column, keep)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []), *keep])

    schema = StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return _two(df, key, text, keep).mapInArrow(batches, StructType([*schema.fields, *[df.schema[c] for c in keep]]))


def _two(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
