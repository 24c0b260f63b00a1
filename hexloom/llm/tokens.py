"""Whole texts to ids of a byte-level BPE vocabulary, spelling each distinct piece only once.

A text is cut before every space that stands alone between two other characters. The vocabulary's
own word pattern never joins characters across such a cut, so pieces are encoded independently and
their ids joined. Texts with other white space next to a space take the slower way through the
library as a whole.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable

import numpy as np

#: Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces kept by a worker, and the characters of a piece that is worth keeping.
KEPT, LONGEST = 400_000, 64


def little_endian(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """``ids(texts)``: the ids of each text as bytes, little-endian unsigned 32 bits.

    ``spell`` encodes a list of pieces to such bytes; ``whole`` does so for entire texts.
    """

    def __init__(self, spell: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]] | None = None):
        self.spell, self.whole = spell, whole or spell
        #: By piece without its space. False: white space at its edge belongs to what stands beyond the cut.
        self.known: dict[str, bytes | bool] = {}

    def _learn(self, new: list[str], lead: str) -> dict[str, bytes | bool]:
        safe = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        return dict.fromkeys(new, False) | dict(zip(safe, self.spell([lead + p for p in safe]), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        known = self.known
        cut = [text.split(" ") for text in texts]
        found = [list(map(known.get, pieces[1:])) for pieces in cut]
        new = {p for pieces, ids in zip(cut, found, strict=True) if None in ids for p, i in zip(pieces[1:], ids) if i is None}
        fresh = self._learn(list(new), " ")
        if len(known) < KEPT:  # what is frequent comes early
            known.update((p, i) for p, i in fresh.items() if len(p) <= LONGEST)
        firsts = self._learn(list({pieces[0] for pieces in cut}), "")
        out = []
        for text, pieces, ids in zip(texts, cut, found, strict=True):
            if None in ids:
                ids = [fresh[p] if i is None else i for p, i in zip(pieces[1:], ids, strict=True)]
            first = firsts[pieces[0]]
            if not text:
                out.append(b"")
            elif first is False or False in ids:
                out.append(self.whole([text])[0])
            else:
                out.append(first + b"".join(ids))
        return out


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def library(path: str) -> tuple[Callable[[list[str]], list[bytes]], Callable[[list[str]], list[bytes]]]:
    """Encode with the tiktoken library, whose ids for such a vocabulary are the same and come sooner.

    Ids of a byte-level vocabulary are the ranks of its merges; its added tokens are found in texts.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    encoding = tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    size = np.zeros(encoding.n_vocab, np.int64)
    for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
        size[i] = len(token)

    def encode(text: str) -> np.ndarray:
        marked = any(s in text for s in special)
        return np.array(encoding.encode(text, allowed_special="all") if marked else encoding.encode_ordinary(text), "<u4")

    def spell(texts: list[str]) -> list[bytes]:
        return [encode(t).tobytes() for t in texts]

    def spell_pieces(pieces: list[str]) -> list[bytes]:
        """Pieces that begin with a lone space are encoded as one text and told apart by their bytes."""
        joined = [p for p in pieces if p[0] == " "]
        ids = encode("".join(joined))
        ends = np.cumsum(np.fromiter((len(p.encode("utf-8", "surrogatepass")) for p in joined), np.int64, len(joined)))
        places = 4 * np.searchsorted(np.cumsum(size[ids]), ends, side="left") + 4
        raw, at, out = ids.tobytes(), 0, {}
        for p, end in zip(joined, places.tolist(), strict=True):
            out[p] = raw[at:end]
            at = end
        return [out[p] if p in out else encode(p).tobytes() for p in pieces]

    return spell_pieces, spell
