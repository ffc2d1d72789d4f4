"""Byte-pair encoding by a trie of distinct words, and decoding.

The last token of the encoding of every prefix of a word is determined by the last tokens of
its shorter prefixes: it is the one token t that ends the prefix and may follow the last token
of the rest, where one token may follow another if encoding the two together would not merge
across their border. So the distinct words of a batch are put in order, which is a depth-first
walk of their trie, and the walk keeps the last token of each prefix of its path: what two
words share at the front is encoded once. Reading the last tokens backwards gives a word's
encoding. Tasks work on their own rows; no words are gathered across tasks.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, thrifty

#: White space as the pre-tokeniser knows it (fixed values).
_W = r"\t-\r \x85\xa0  -     　"
#: The pattern of byte-level BPE that splits text before merges (fixed values).
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
#: Characters encoded together; words in each of a task's two generations, and pairs remembered
#: before it starts anew. All but the words of one group is bounded by them.
GROUP, WORDS, PAIRS = 1 << 20, 150_000, 300_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


@lru_cache(maxsize=1)
def _newer_letters() -> dict[int, str]:
    """Letters and numbers of a Unicode version after the pre-tokeniser's, which is that of
    ``unicodedata``; each stands for itself as a character that is neither.
    """
    letter, found = regex.compile(r"[\p{L}\p{N}]"), {}
    for low in range(0, sys.maxunicode + 1, 4096):  # all characters at once would take 120 MB for a moment
        every = "".join(map(chr, range(low, low + 4096))) if not 0xD800 <= low < 0xE000 else ""
        found |= {ord(c): "\ue000" for c in letter.findall(every) if unicodedata.category(c)[0] not in "LN"}
    return found


class Coder:
    """Encodes and decodes texts by a vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = len(merges)
        self.rank: dict[int, dict[int, int]] = {}  # of the merge of two tokens, by the left and then the right one
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault(vocab[a], {})[vocab[b]] = r
        # how each token is made: its two parts, and the rank of their merge
        self.born = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.ends = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        # lengths, longest first, of the tokens that can end where a word's last bytes are these
        endings = {b[-3:] for b in self.ends if len(b) > 2}
        sizes = {e: {n for n in (1, 2) if e[-n:] in self.ends} for e in endings}
        for b in self.ends:
            if len(b) > 2:
                sizes[b[-3:]].add(len(b))
        self.sizes = {e: tuple(sorted(n, reverse=True)) for e, n in sizes.items()}
        self.plain_split = regex.compile(_SPLIT).findall
        self.newer = _newer_letters()
        self.newer_chars = frozenset(map(chr, self.newer))
        self.odd = re.compile(rf" [{_W}]|[{_W}] |\0").search
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # ids of words, and of chunks of words; of the older ones those in use move to the newer
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stand at a token's left (0) or right (1) edge while it is made, each
        with the rank of the merge that takes it up.
        """
        out = self.edges[side].get(token)
        if out is None:
            out, taken, now = [], self.merges, token
            while now is not None:
                out.append((now, taken))
                _, _, taken = made = self.born.get(now, (None, None, 0))
                now = made[side]
            self.edges[side][token] = out
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together gives a, b.

        A merge of x, at a's right edge, with y, at b's left edge, comes first if it ranks
        before the merge that takes x up, and not after the one that takes y up: of equal
        merges the one further left is made first.
        """
        found = self.pairs.get((a, b))
        if found is None:
            found, left = True, self.edge(b, 0)
            for x, x_ends in self.edge(a, 1):
                with_x = self.rank.get(x)
                if with_x is None:
                    continue
                for y, y_ends in left:
                    r = with_x.get(y)
                    if r is not None and r < x_ends and r <= y_ends:
                        found = False
                        break
                if not found:
                    break
            self.pairs[a, b] = found
        return found

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words in one walk of their trie."""
        path, last, size, ends, packed, sizes = b"", [], [], self.ends, self.packed, self.sizes
        may_follow, pairs = self.may_follow, self.pairs
        for raw, word in sorted((w.encode("utf-8"), w) for w in words):
            shared, most = 0, min(len(path), len(raw))
            while shared < most and path[shared] == raw[shared]:
                shared += 1
            del last[shared:], size[shared:]
            for end in range(shared + 1, len(raw) + 1):
                for n in sizes.get(raw[end - 3 if end > 3 else 0 : end], (2, 1)):
                    if n > end:
                        continue
                    at = end - n
                    token = ends.get(raw[at:end])
                    if token is None:
                        continue
                    if not at:
                        break
                    before = last[at - 1]
                    good = pairs.get((before, token))
                    if good or good is None and may_follow(before, token):
                        break
                last.append(token)
                size.append(end - at)
            path, at, out = raw, len(raw), []
            while at:
                out.append(packed[last[at - 1]])
                at -= size[at - 1]
            self.known[word] = b"".join(reversed(out))

    def split(self, text: str) -> list[str]:
        """The words of a text, which merges do not leave."""
        if text.isascii() or self.newer_chars.isdisjoint(text):
            return self.plain_split(text)
        ends = list(accumulate(map(len, self.plain_split(text.translate(self.newer)))))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def _chunks_of(self, text: str) -> list[str]:
        """Pieces of a text between which no token reaches, most of them one word."""
        if self.odd(text):
            return self.split(text)
        return text.replace(" ", "\0 ").removeprefix("\0").split("\0")

    def recall(self, pieces: Iterable[str]) -> set[str]:
        """The pieces that are not known; those of the older generation become newer ones."""
        known, older = self.known, self.older
        missing = {p for p in pieces if p not in known}
        for p in missing & older.keys():
            known[p] = older[p]
        return missing - known.keys()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > WORDS:
            self.known, self.older = {}, self.known
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        plans: list[list[list[str] | bytes]] = []
        new: set[str] = set()
        for text in texts:
            plan: list[list[str] | bytes] = []
            at = 0
            for found in self.specials.finditer(text) if self.specials else ():
                if found.start() > at:
                    plan.append(self._chunks_of(text[at : found.start()]))
                plan.append(self.packed[self.special[found[0]]])
                at = found.end()
            if at < len(text):
                plan.append(self._chunks_of(text[at:]))
            for part in plan:
                if isinstance(part, list):
                    new.update(part)
            plans.append(plan)
        cut: dict[str, list[str]] = {}
        single: set[str] = set()  # most chunks are one word, which is not kept twice
        for chunk in self.recall(new):
            words = self.split(chunk)
            if len(words) > 1:
                cut[chunk] = words
            else:
                single.add(chunk)
        del new
        self.learn(self.recall(single.union(*cut.values())))
        del single
        of = self.known.__getitem__
        for chunk, words in cut.items():
            self.known[chunk] = b"".join(map(of, words))
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(of, p)) for p in plan]) for plan in plans]

    def forget(self) -> None:
        """Drop what was learned: the vocabulary alone is kept between tasks."""
        self.known, self.older, self.edges = {}, {}, ({}, {})
        self.pairs.clear()

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = memoryview(packed).cast("I").tolist() if packed else []
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the token ids of every whole text, packed little-endian in 4 bytes each.

    ``vocabulary`` is the path, on every executor, of a byte-level BPE file of the tokenizers
    library. Ids are as it gives them without added special tokens; a special token's string
    in a text is that token. Null and empty texts have no tokens (an empty binary). One row
    per input row, null ids too; other columns are ignored. The session gets a limit of the
    bytes sent to Python at once, if it has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary)
        for batch in batches:
            at, held, texts = 0, 0, []
            for i in range(len(batch)):
                texts.append(batch.column(1)[i].as_py() or "")
                held += len(texts[-1])
                if held >= GROUP or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(code.encode(texts), pa.binary())], [id_col, "ids"])
                    at, held, texts = i + 1, 0, []
        code.forget()

    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(chosen.mapInArrow(thrifty(run), f"`{id_col}` long, ids binary"))


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, text): ``encode``'s rows with the text that their ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                text = [code.decode(x.as_py() or b"") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [id_col, "ids", "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` long, ids binary, text string")


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
