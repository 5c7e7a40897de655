"""Token ids of whole texts by a vocabulary file, with the ids of chunks kept per worker.

The vocabulary files used here drop white space before they split a text further, so a chunk between
two runs of white space has the same ids wherever it stands. So has what stands between a letter, a
digit and a mark other than an apostrophe: their tokenizer's pattern always cuts there, so white space
is put there. The library is asked once per chunk.
"""

from __future__ import annotations

import functools
import os

import numpy as np

#: A special token of the vocabulary, which no chunk of the joined ones holds.
MARK = "<|startoftext|>"
#: Chunks of each of the two generations that a worker keeps.
KEPT_CHUNKS = 250_000
#: Classes of bytes: letters, digits and marks of ASCII; white space, the apostrophe and all others are 0.
_LETTER, _DIGIT, _MARK = 1, 2, 3
_CLASS = np.array([_LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK if 0x21 <= b < 0x7F and b != 0x27 else 0 for b in range(128)] + [0] * 128, "u1")


def chunks_of(texts: list[str | None]) -> list[list[bytes]]:
    """The chunks of each text, lower-cased where that is safe."""
    blobs, whole = [], []
    for text in texts:
        blob = (text or "").encode()
        special = b"<|" in blob  # special tokens are told apart by case, and hold marks
        if not special and b"\xcc" not in blob and b"\xcd" not in blob:  # a letter may compose with a mark after it
            blob = blob.lower()
        blobs.append(blob)
        whole.append(special)
    data = np.frombuffer(b"\n".join(blobs) + b"\n", "u1")
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # Latin letters of two bytes, but for the signs of multiplication and division
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cut &= (kind[1:] > 0) & (kind[:-1] > 0)
    sizes = np.array([len(b) + 1 for b in blobs], "i8")
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(whole).tolist():
        cut[ends[k] - sizes[k] : ends[k] - 1] = False
    at = np.flatnonzero(cut) + 1
    spaced = np.insert(data, at, 0x20).tobytes()
    ends = (ends + np.searchsorted(at, ends)).tolist()
    return [spaced[begin:end].split() for begin, end in zip([0, *ends[:-1]], ends, strict=True)]


@functools.lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkEncoder:
    """Little-endian unsigned 32-bit ids of texts. Chunks not met for a generation are forgotten."""

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older = library(path), {}, {}
        self.mark = self.tokenizer.token_to_id(MARK)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # entries that end a word
        self.ends[[n for word, n in vocab.items() if word.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, "<u4") for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        words = [x for x in chunks if x.isalpha()]  # ASCII letters alone: one word each
        rest = [x for x in chunks if not x.isalpha()]
        for own, between in ((words, " "), (rest, MARK)):
            parts = [own[at : at + 200] for at in range(0, len(own), 200)]
            for part, ids in zip(parts, self._ids([between.join([x.decode() for x in part]) for part in parts]), strict=True):
                flat, at = ids.tobytes(), 0
                if own is words:
                    stops = np.flatnonzero(self.ends[ids]) + 1
                    for chunk, end in zip(part, stops.tolist(), strict=True):
                        self.known[chunk] = flat[4 * at : 4 * end]
                        at = end
                else:
                    for chunk, end in zip(part, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], strict=True):
                        self.known[chunk] = flat[4 * at : 4 * end]
                        at = end + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = chunks_of(texts)
        if len(self.known) > KEPT_CHUNKS:
            self.known, self.older = {}, self.known
        new = set().union(*split).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((x, self.older[x]) for x in again)
        new = list(new - again)
        if odd := [x for x in new if b"<|" in x]:
            for chunk, ids in zip(odd, self._ids([x.decode() for x in odd]), strict=True):
                self.known[chunk] = ids.tobytes()
            new = [x for x in new if b"<|" not in x]
        self._learn(new)
        of = self.known.__getitem__
        return [b"".join(map(of, x)) for x in split]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    return ChunkEncoder(path)
