"""Exact tokenizer calls with a bounded memo over the chunks between single spaces."""

from __future__ import annotations

import hashlib
import json

import numpy as np

#: Chunks that one worker's memo holds at most; a full memo is emptied, which only costs time.
MEMO = 150_000
#: The published split pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _bytes_of_printable() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + k)] = b
    return out


class ByteBPE:
    """The ids of a byte-level BPE as the tokenizers library gives them with add_special_tokens=False.

    No pre-token reaches from a character over a single space into the next one, so a text is cut before each
    single space between characters that aren't white space, and the chunks' ids are looked up. A text with any
    other white space around a space is encoded whole; one that holds an added token's string goes to the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.added = [t["content"] for t in model.get("added_tokens", [])]
        stand_in = _bytes_of_printable()
        ranks = {bytes(stand_in[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in self.added}
        self.library = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(a in text for a in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = text.split(" ")
        if len(chunks) == 1:
            return self.whole(text)
        first = chunks[0]
        if not first or first[-1].isspace():
            return self.whole(text)
        chunks[0] = self.whole(first)
        memo = self.memo
        for k in range(1, len(chunks)):
            chunk = chunks[k]
            known = memo.get(chunk)
            if known is None:
                if not chunk or chunk[0].isspace() or (chunk[-1].isspace() and k < len(chunks) - 1):
                    return self.whole(text)
                known = self.whole(" " + chunk)
                if not chunk[-1].isspace() and len(chunk) < 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[chunk] = known
            chunks[k] = known
        return b"".join(chunks)


class PieceCounter:
    """How many pieces a SentencePiece model makes of a text, without begin or end.

    The model writes a space as one character that no piece of the vocabulary has after another character, so
    no piece reaches over a space; chunks between single spaces are counted alone. A text with other runs of
    spaces or with that character itself is encoded whole. A vocabulary that breaks the rule is never memoised.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.library.id_to_piece(k) for k in range(self.library.get_piece_size()))
        self.splits = not any(self.MARK in p.lstrip(self.MARK) or " " in p for p in pieces)
        self.splits &= len(self.library.encode("a  b")) != len(self.library.encode("a b"))
        self.memo: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.library.encode(text))

    def count(self, text: str) -> int:
        if not self.splits or self.MARK in text or not text:
            return self.whole(text)
        memo, chunks = self.memo, text.split(" ")
        known = list(map(memo.get, chunks))
        if None in known:
            if "" in chunks:
                return self.whole(text)
            new = list(dict.fromkeys(c for c, n in zip(chunks, known) if n is None))
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(dict.fromkeys(chunks))
            counted = dict(zip(new, map(len, self.library.encode(new, num_threads=1))))
            memo.update((c, n) for c, n in counted.items() if len(c) < 64)
            known = [n if n is not None else counted[c] for c, n in zip(chunks, known)]
        return sum(known)
