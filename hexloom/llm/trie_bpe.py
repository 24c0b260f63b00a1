"""Byte-level BPE by a walk over the trie of distinct words, and back.

The encoding of a string ends in one certain token, and what stands before that token is the encoding
of the shorter string. So each node of a trie needs only its last token: of the tokens that its path
ends in, the one that the merge rules leave standing after the last token of the node where it
begins. Words sorted by bytes are the trie in depth-first order: each shares its path with the one
before it up to their common prefix, whose last tokens are kept, and only the rest is computed.

Whether two tokens stand beside each other is asked of the merge rules once per pair of tokens. The
pattern that cuts texts into words, and the table of byte letters, come from the vocabulary's format.

Defined cases: a null or empty text has no ids and decodes to the empty text; special tokens in a text
are single ids, as in the library; repeated rows are encoded each for itself; an empty table gives an
empty result; a very long word costs time in proportion to its length; other columns take no part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import small_batches, whole_text
from hexloom.llm.tokens import WORDS, Encoder, byte_letters, little_endian

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TrieBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.id = {raw[token]: i for token, i in ids.items()}
        self.bytes = {i: raw[token] for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {ids[a] << 20 | ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.starts = {token[:n] for token in self.id for n in range(1, len(token) + 1)} | {b""}
        self.step: dict[tuple[bytes, int], bytes] = {}
        self.ends: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self.beside: dict[int, bool] = {}
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merged(self, string: bytes) -> list[int]:
        """The ids of a short string by the merge rules themselves: lowest rank first, leftmost of equals."""
        parts = [self.id[string[i : i + 1]] for i in range(len(string))]
        rank, none = self.rank, 1 << 30
        ranks = [rank.get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] << 20 | parts[i], none)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] << 20 | parts[i + 1], none)
        return parts

    def _follow(self, tail: bytes, byte: int) -> bytes:
        """Longest ending of tail + byte that some token starts with."""
        longer = tail + bytes((byte,))
        while longer not in self.starts:
            longer = longer[1:]
        return longer

    def _endings(self, tail: bytes) -> tuple[tuple[int, int], ...]:
        """(id, length) of the tokens that ``tail`` ends in, longest first, that the rules build at all."""
        found = [(self.id[tail[i:]], len(tail) - i) for i in range(len(tail)) if tail[i:] in self.id]
        return tuple((t, n) for t, n in found if n == 1 or self.merged(self.bytes[t]) == [t])

    def _stand(self, before: int, token: int) -> bool:
        return self.merged(self.bytes[before] + self.bytes[token]) == [before, token]

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct word, as little-endian unsigned 32 bits."""
        out: dict[bytes, bytes] = {}
        step, ends, beside, pack = self.step, self.ends, self.beside, little_endian
        tails: list[bytes] = [b""]
        last: list[tuple[int, int]] = [(-1, 0)]  # (id, length) of the last token at each depth of the path
        previous = b""
        for word in sorted(words):
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del tails[shared + 1 :], last[shared + 1 :]
            for depth in range(shared, len(word)):
                key = (tails[depth], word[depth])
                tail = step.get(key)
                if tail is None:
                    tail = step[key] = self._follow(*key)
                tails.append(tail)
                options = ends.get(tail)
                if options is None:
                    options = ends[tail] = self._endings(tail)
                for option in options:
                    before = last[depth + 1 - option[1]][0]
                    if before < 0:
                        break
                    pair = before << 20 | option[0]
                    fits = beside.get(pair)
                    if fits is None:
                        fits = beside[pair] = self._stand(before, option[0])
                    if fits:
                        break
                last.append(option)
            ids, depth = [], len(word)
            while depth:
                token, size = last[depth]
                ids.append(token)
                depth -= size
            out[word] = pack(ids[::-1])
            previous = word
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts: special tokens first, then words, each distinct word once."""
        cut = []
        for text in texts:
            parts = self.specials.split(text) if self.specials else [text]
            cut.append([w if w in self.special else w.encode("utf-8", "surrogatepass")
                        for part in parts for w in ([part] if part in self.special else self.words.findall(part))])
        spelt: dict = self.encode_words(list({w for ws in cut for w in ws if isinstance(w, bytes)}))
        spelt |= {s: i.to_bytes(4, "little") for s, i in self.special.items()}
        return [b"".join([spelt[w] for w in ws]) for ws in cut]

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_CODERS: dict[str, tuple[TrieBpe, Encoder]] = {}


def coder(vocabulary: str) -> tuple[TrieBpe, Encoder]:
    """One per worker process, as its tables are worth keeping between tasks."""
    if vocabulary not in _CODERS:
        trie = TrieBpe(vocabulary)
        _CODERS[vocabulary] = (trie, Encoder(trie.encode))
    return _CODERS[vocabulary]


def round_trip(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode whole texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, encoder = coder(vocabulary)
        for batch in batches:
            ids = encoder.ids(batch.column(1).to_pylist())
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(trie.decode(i).encode()).hexdigest() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), whole_text(text)).mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids themselves."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = coder(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in encoder.ids(batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), whole_text(text)).mapInArrow(run, "doc_id long, ids array<int>")
