"""Encoding with a vocabulary file of the tokenizers library, word by word with a bounded memo.

The library's pre-tokenizer never joins what white space parts, so a text's ids are those of its
chunks between ASCII white space, one after another. Each chunk that the memo lacks goes through the
library; the memo only saves encoding a frequent chunk again, and is bounded in entries. ASCII capitals are lower-cased first where
the vocabulary's normalizer lower-cases anyway, but not in a chunk where one may compose with a mark after
it, as NFC comes before lower case. A chunk of Latin letters, digits and ASCII signs falls
apart into the same pieces for any such vocabulary (letters, one digit, other signs), which the
library's model encodes one by one; every other chunk takes the library's whole path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: Entries of a memo before it is emptied, some 150 bytes each; a worker has two.
MEMO_ENTRIES = 300_000
#: Stands between the ids of chunks for a moment; no vocabulary has so high an id.
_APART = b"\xff" * 4
#: Chunks whose pieces are known without the library: no apostrophe, as contractions are pieces of their own.
_PLAIN = re.compile("[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PIECE = re.compile("[a-zA-Z\u00c0-\u017f]+|[0-9]|[^ a-zA-Z0-9\u00c0-\u017f]+| ")
#: A capital with a mark of U+0300 to U+036F among the characters beyond ASCII after it: only its small letter may have a composed form.
_MARKED = re.compile(rb"[A-Z][\x80-\xff]*?[\xcc\xcd]")


def _chunks(text: bytes) -> list[bytes]:
    if b"<" in text:
        return text.split()
    if (b"\xcc" not in text and b"\xcd" not in text) or not _MARKED.search(text):
        return text.lower().split()
    return [c if _MARKED.search(c) else c.lower() for c in text.split()]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """texts -> ids as little-endian unsigned 32-bit bytes, equal to encoding each whole text."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normalizer = json.dumps(spec.get("normalizer"))
        pre = json.dumps(spec.get("pre_tokenizer"))
        self.by_chunk = '"Lowercase"' in normalizer and '"Removed"' in pre
        #: Added tokens stand for themselves in a text; one with white space would span chunks.
        self.by_chunk &= not any(set(" \t\n\r\v\f") & set(t["content"]) for t in spec.get("added_tokens", []))
        #: Added tokens are found before lower-casing; all begin with "<", so such texts keep their capitals.
        self.by_chunk &= all(t["content"].startswith("<") for t in spec.get("added_tokens", []))
        self.memo: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.memo_entries = memo_entries
        self.by_piece = self.by_chunk and '"ByteLevel"' in pre and "p{L}]+|[\\\\p{N}]|[^" in pre and '"NFC"' in normalizer and self.tokenizer.get_vocab_size() < 1 << 24
        self.letters = str.maketrans({b: c for b, c in enumerate(_byte_letters())})

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in out]

    def _plain(self, chunks: list[str]) -> list[bytes]:
        """Ids of plain chunks, all cut into pieces at once; a space stands between chunks."""
        cut = _PIECE.findall(" ".join(chunks).lower())
        if len(self.pieces) > self.memo_entries:
            self.pieces.clear()
        known, tokenize = self.pieces, self.tokenizer.model.tokenize
        known[" "] = _APART
        for p in set(cut).difference(known):
            shown = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            known[p] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(shown)])
        return b"".join(map(known.__getitem__, cut)).split(_APART)

    def _chunks_anew(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Chunks that the memo lacks, with their ids."""
        texts = b" ".join(chunks).decode().split(" ")
        plain = [self.by_piece and _PLAIN.fullmatch(x) is not None for x in texts]
        for want, encode in ((True, self._plain), (False, self._library)):
            if some := [x for x, is_plain in zip(texts, plain, strict=True) if is_plain is want]:
                yield from zip([c for c, is_plain in zip(chunks, plain, strict=True) if is_plain is want], encode(some), strict=True)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A few MB of text at a time, so what is held beside the memo is bounded."""
        if not self.by_chunk:
            return self._library([t or "" for t in texts])
        out: list[bytes] = []
        part, size = [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= 1 << 21:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part) if part else out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.memo_entries:
            self.memo.clear()
        split = [_chunks(t.encode()) for t in texts]
        if missing := list(set().union(*split).difference(self.memo)):
            self.memo.update(self._chunks_anew(missing))
        return [b"".join(map(self.memo.__getitem__, chunks)) for chunks in split]

    def forget(self) -> None:
        """Empty the memos, so an idle worker holds little."""
        self.memo.clear()
        self.pieces.clear()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary file in a Python worker; workers are reused by later tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
