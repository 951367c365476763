"""BPE encoding and decoding with a public vocabulary file.

Method: each word is a doubly linked list of symbols (arrays of previous and next positions). Every adjacent pair
that the vocabulary can merge sits in a priority queue under its merge rank and position. The lowest entry is
taken; it is stale, and skipped, if its left symbol has gone or its pair is no longer the one that was queued.
A merge relinks the list and queues the two new neighbours. Decoding concatenates the vocabulary strings.

The file is read once on the driver and broadcast (its size is that of a vocabulary, checked against
``MAX_FILE_BYTES``). Words repeat, so each worker keeps the encodings of what it has seen, up to ``cache_words``
of them; what falls out is encoded again, so results do not depend on the cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows

MAX_FILE_BYTES = 64 << 20
CACHE_WORDS = 250_000
#: Of runs a worker remembers one for so many words: most runs differ by punctuation only, and a word costs more to encode.
RUNS_PART = 2
#: Longer runs and words are not remembered.
REMEMBERED = 48
#: Bits of a symbol's id in a pair's key.
PAIR = 32
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take the code points from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def load(path: str) -> str:
    """The vocabulary file's text, for ``Bpe``; raises ValueError if it is over MAX_FILE_BYTES."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return text


class Bpe:
    """Encoder and decoder for a ``tokenizers`` file whose model is byte-level BPE with a word-end suffix."""

    def __init__(self, file_text: str, cache_words: int = CACHE_WORDS):
        spec = json.loads(file_text)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or model.get("byte_fallback"):
            raise ValueError("only BPE files without a decoder and without byte fallback")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.decimals = {i: str(i) for i in self.strings}
        #: Left symbol << PAIR | right symbol -> (rank, merged symbol).
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << PAIR | self.vocab[b]] = (rank, self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab.get(c, -1) for c in symbols]
        self.last = [self.vocab.get(c + self.suffix, -1) for c in symbols]
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        known = [n["type"] if n["type"] != "Replace" else n["pattern"].get("Regex") for n in steps]
        if not {*known} <= {"NFC", "Lowercase", r"\s+"}:
            raise ValueError("only NFC, lower case and white-space normalizers")
        self.composes, self.lowers = "NFC" in known, "Lowercase" in known
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("only files that keep the matches of their split pattern")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V0).findall
        self.letters_are_words = self.words("aé漢ǰ") == ["aé漢ǰ"]
        stops = sorted(self.special, key=len, reverse=True)
        self.stop = regex.compile("(" + "|".join(map(regex.escape, stops)) + ")") if stops else None
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.seen = _Seen(self, cache_words)

    def normalize(self, text: str) -> str:
        """NFC and lower case as the file asks for; white space only separates words, so its form is left alone."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text) if self.composes else text
            text = text.replace("Σ", "σ") if self.lowers else text  # letter by letter: a final sigma has no form of its own
        return text.lower() if self.lowers else text

    def merge(self, word: str) -> list[int]:
        """The ids of one word: merges by rank from a priority queue over a doubly linked list of symbols."""
        raw = word.encode("utf-8", "surrogatepass")
        inner, find, pop, push = self.inner, self.merges.get, heapq.heappop, heapq.heappush
        symbols = [inner[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        if -1 in symbols:
            symbols = [s for s in symbols if s >= 0]
        n = len(symbols)
        queue = [(m[0], i, m[1]) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (m := find(a << PAIR | b))]
        if not queue:
            return symbols
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heapq.heapify(queue)
        while queue:
            rank, i, made = pop(queue)
            left, j = symbols[i], after[i]
            if left < 0 or j < 0 or (m := find(left << PAIR | symbols[j])) is None or m[0] != rank:
                continue  # stale: the left symbol went into another, or its neighbour changed
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := find(made << PAIR | symbols[k]):
                    push(queue, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := find(symbols[h] << PAIR | made)):
                push(queue, (m[0], h, m[1]))
        return [s for s in symbols if s >= 0]

    def parts(self, text: str | None) -> list[str]:
        """The text's runs without white space, in order; special tokens stand alone.

        No word and no normal form reaches across white space, so each run has one encoding wherever it stands.
        """
        out: list[str] = []
        text = text or ""
        for piece in self.stop.split(text) if any(x in text for x in self.special) else [text]:
            if piece in self.special:
                out.append(" " + piece)
                continue
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw.translate(None, b"\x1c\x1d\x1e\x1f")) != len(raw):  # str.split would take these as white space
                out += [x for x in self.spaces.split(piece) if x]
            else:
                out += (piece.lower() if self.lowers and piece.isascii() else piece).split()
        return out

    def text_forms(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the decimal ids joined by one space, and the decoded text."""
        seen = list(map(self.seen.__getitem__, self.parts(text)))
        ids = " ".join([x[0] for x in seen if x[0]])
        return (ids.count(" ") + 1 if ids else 0), ids, " ".join([x[1] for x in seen if x[0]])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.text_forms(text)[1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings of the known ids; without a decoder in the file they are joined by a space."""
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])


class _Seen(dict):
    """Run without white space, or a space and a special token -> (decimal ids, decoded strings), each joined by a space.

    Words are remembered apart, as many runs differ by punctuation only. Either memory is emptied when it is full. What is longer
    than ``REMEMBERED`` characters is encoded each time, so both memories are bounded in bytes too.
    """

    def __init__(self, bpe: Bpe, most: int):
        super().__init__()
        self.bpe, self.most, self.runs, self.known = bpe, most, max(1, most // RUNS_PART), {}

    def _forms(self, ids: list[int]) -> tuple[str, str]:
        return " ".join([self.bpe.decimals[i] for i in ids]), self.bpe.decode(ids)

    def word(self, word: str) -> tuple[str, str]:
        if len(word) > REMEMBERED:
            return self._forms(self.bpe.merge(word))
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= self.most:
                self.known.clear()
            out = self.known[word] = self._forms(self.bpe.merge(word))
        return out

    def __missing__(self, run: str) -> tuple[str, str]:
        bpe = self.bpe
        if run[0] == " ":
            out = self._forms([bpe.special[run[1:]]])
        else:
            text = bpe.normalize(run)
            if bpe.letters_are_words and text.isalpha():
                out = self.word(text)
            else:
                found = [x for w in bpe.words(text) if (x := self.word(w))[0]]
                out = found[0] if len(found) == 1 else (" ".join([x[0] for x in found]), " ".join([x[1] for x in found]))
        if len(run) <= REMEMBERED:
            if len(self) >= self.runs:
                self.clear()
            self[run] = out
        return out


_MADE: dict[tuple[str, int], Bpe] = {}


def shared(file_text: str, cache_words: int) -> Bpe:
    """One coder for each worker process: later tasks find its vocabulary and words."""
    key = (hashlib.sha256(file_text.encode()).hexdigest(), cache_words)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Bpe(file_text, cache_words)
    return _MADE[key]


def _row(bpe: Bpe):
    def digest(key: int | None, text: str | None) -> tuple:
        n, ids, decoded = bpe.text_forms(text)
        return (
            key, n, hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
        )

    return digest


def _ids_row(bpe: Bpe):
    def row(key: int | None, text: str | None) -> tuple:
        n, ids, decoded = bpe.text_forms(text)
        return key, n, [int(i) for i in ids.split()], decoded

    return row


def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """``key``, ``n_tokens``, ``ids array<int>`` and ``decoded string`` for every row of ``df``.

    Null texts count as empty and give no ids; null keys and repeated rows stay; an empty table gives an empty
    table; other columns are not read.
    """
    return _map(df, path, key, text, cache_words, _ids_row, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """As ``encode_texts``, with checksums of the ids and of the decoded text in their place."""
    return _map(df, path, key, text, cache_words, _row, f"doc_id long, {SCHEMA}")


def _map(df, path, key, text, cache_words, make, schema) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(load(path))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_rows(rows, lambda: make(shared(held.value, cache_words)), schema)
