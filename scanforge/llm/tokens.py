"""Token ids of texts as packed unsigned 32-bit little-endian integers."""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array

import numpy as np

#: Finds a space that does not lie between two characters that are surely no white space.
#: Elsewhere a byte-level pre-tokeniser always cuts before a space, so that what lies between
#: two spaces, with the first of them, is tokenised by itself.
_UNSURE = re.compile(r" (?:(?![\w!-~])|(?<![\w!-~] ))")

#: Longest stretch that is remembered.
_LONGEST = 64


def _bytes_of_characters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes texts with a tokenizer file of ``tokenizers``.

    Where the file is a plain byte-level BPE, each distinct stretch between spaces is encoded
    once and remembered, by merging with ``tiktoken`` under the file's own vocabulary, which
    gives the same ids several times faster; whatever else goes through ``tokenizers``, texts
    that hold one of the file's added tokens too, which become that token's id. At
    most twice ``most_cached`` stretches are remembered: when the newer half is full, the
    older is forgotten.
    """

    def __init__(self, path: str, most_cached: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_cached = most_cached
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"):
            import public_tokenizers
            import tiktoken

            of = _bytes_of_characters()
            added = {t["id"] for t in spec.get("added_tokens", [])}
            self.added = [t["content"] for t in spec.get("added_tokens", [])]
            ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in added}
            self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
            self.bytes_of[list(ranks.values())] = [len(token) for token in ranks]
            self.fast = tiktoken.Encoding("stretches", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[bytes] = []
        for start in range(0, len(texts), 256):
            out += self._some(texts[start : start + 256])
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        pieces = [None if _UNSURE.search(t) or any(x in t for x in self.added) else t.split(" ") for t in texts]
        sure = [own for own in pieces if own]
        new = set().union(*sure).difference(self.newer)
        if len(self.newer) + len(new) > self.most_cached:
            self.older, self.newer = self.newer, {}
            new = set().union(*sure)
        newer, older = self.newer, self.older
        known = {p: older[p] for p in new if p in older}
        newer.update(known)
        new.difference_update(known)
        new.discard("")
        long = {}
        for p, ids in zip(new, self._stretches(new), strict=True):
            if len(p) <= _LONGEST:
                newer[p] = ids
            else:
                long[p] = ids
        get, out = newer.get, []
        for t, own in zip(texts, pieces, strict=True):
            if own is None:
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
                continue
            first = array("I", self.fast.encode_ordinary(own[0])).tobytes()
            own[0] = ""
            newer[""] = first
            out.append(b"".join([long[p] if p in long else get(p) for p in own] if long else map(get, own)))
        newer.pop("", None)
        return out

    def _stretches(self, stretches: set[str]) -> list[bytes]:
        """Ids of each stretch after a space. They are merged as one text and cut by length in bytes."""
        if not stretches:
            return []
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(stretches)), "<u4")
        ends = np.cumsum([len(p.encode("utf-8")) + 1 for p in stretches])
        cuts = [0, *(4 * (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1)).tolist()]
        raw = ids.tobytes()
        return [raw[i:j] for i, j in itertools.pairwise(cuts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, one for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
